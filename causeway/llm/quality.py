"""Quality scores by a factorisation machine.

Inputs of a text are its hashed words (by share of all words), structure statistics and the length in the
documents' metadata.  The machine has a weight for each input and a short vector for each, and
adds the products of all pairs of inputs weighted by their vectors' inner product.  With
``s = sum_i v_i x_i`` that sum over pairs is ``(|s|^2 - sum_i |v_i|^2 x_i^2) / 2``, so a score takes time linear in the inputs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import LabelledSample, fold_of, kept, labelled_sample, map_batches

FOLDS, HELD_OUT = 5, 0
#: Labelled texts of each class that are fitted on, at most, and bytes of all of them.
PER_CLASS, CLASS_BYTES = 2000, 16 << 20
#: Buckets that words are hashed into, length of the vectors, and passes of the fit.
BUCKETS, FACTORS, PASSES = 1 << 14, 8, 12
RATE, WORD_DECAY, DECAY = 0.05, 2e-3, 1e-4
CUT = 0.3
CACHE_WORDS = 150_000
STATISTICS = (
    "bias", "log_words", "word_chars", "distinct_share", "top_word_share", "repeat_share", "bigram_repeat_share", "upper_share", "digit_share",
    "bar_share", "mark_share", "bang_share", "stop_share", "bracket_share", "space_share", "log_lines", "line_repeat_share", "line_words", "short", "log_length",
)


def statistics(text: str, length: int | None = None) -> tuple[list[float], Counter]:
    """The structure statistics of a text, each about -1 to 2, and its words' counts.

    ``length`` is the metadata's length in code points; null stands for the text's own.
    """
    words = text.split()
    n, chars = len(words), max(1, len(text))
    low = [w.lower() for w in words]
    counts = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    pairs = Counter(zip(low, low[1:], strict=False))
    share = lambda x: x / max(1, n)
    values = [
        1.0,
        math.log1p(n) / 5 - 1,
        letters / max(1, n) / 5 - 1,
        share(len(counts)),
        share(max(counts.values(), default=0)),
        share(sum(a == b for a, b in zip(low, low[1:], strict=False))),
        1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
        share(upper),
        10 * sum(map(text.count, "0123456789")) / chars,
        share(text.count("|")),
        share(sum(map(text.count, "#$%&*~^=<>@"))),
        share(text.count("!")),
        5 * share(text.count(".")),
        10 * sum(map(text.count, "()[]{}")) / chars,
        5 * text.count(" ") / chars,
        math.log1p(len(lines)) / 3,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))) / 4,
        1.0 if n < 20 else 0.0,
        math.log1p(chars if length is None else max(0, length)) / 6 - 1,
    ]
    return values, counts


@dataclass
class Model:
    """First ``len(STATISTICS)`` inputs are the statistics (the first is the bias), then the word buckets."""

    weight: np.ndarray
    vector: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def inputs(text: str | None, length: int | None, bucket: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's inputs; ``bucket`` keeps words' buckets."""
    values, counts = statistics(text or "", length)
    if len(bucket) > CACHE_WORDS:
        bucket.clear()
    index = []
    for w in counts:
        b = bucket.get(w)
        if b is None:
            b = bucket[w] = len(STATISTICS) + zlib.crc32(w.encode()) % BUCKETS
        index.append(b)
    k = len(values)
    at = np.empty(k + len(index), np.int64)
    x = np.empty(k + len(index))
    at[:k], x[:k] = np.arange(k), values
    if index:
        at[k:] = index
        own = np.fromiter(counts.values(), float, len(index))
        x[k:] = np.sqrt(own / own.sum())
    return at, x


def raw_score(model: Model, at: np.ndarray, x: np.ndarray) -> float:
    """The machine's sum, by the sum-of-squares identity; ``x`` is scaled."""
    vectors = model.vector[at]
    s = x @ vectors
    return float(model.weight[at] @ x + 0.5 * (s @ s - (x * x) @ (vectors * vectors).sum(1)))


def _scaled(model: Model, x: np.ndarray) -> np.ndarray:
    k = len(STATISTICS)
    x = x.copy()
    x[:k] = np.clip((x[:k] - model.mean) / model.spread, -4, 4)
    x[0] = 1.0
    return x


def fit(sample: LabelledSample) -> Model | None:
    """Adagrad on the logistic loss over labelled texts and their metadata; None where a class is missing.

    A text counts as often as it stands for labelled documents of its class, so that scores are alike however many of each class
    the sample holds.
    """
    rows = sample.rows
    if len({y for _, y in rows}) < 2:
        return None
    mean = sum(sample.weight[y] for _, y in rows) / len(rows)
    weight = {y: w / mean for y, w in sample.weight.items()}
    bucket: dict[str, int] = {}
    made = [inputs(t, n, bucket) for (t, _), n in zip(rows, sample.lengths, strict=True)]
    k, size = len(STATISTICS), len(STATISTICS) + BUCKETS
    first = np.array([x[:k] for _, x in made])
    model = Model(np.zeros(size), np.random.default_rng(7).normal(0, 0.02, (size, FACTORS)), first.mean(0), np.maximum(first.std(0), 1e-3))
    data = [(at, _scaled(model, x), y) for (at, x), (_, y) in zip(made, rows, strict=True)]
    past_w, past_v = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for i in order.permutation(len(data)):
            at, x, y = data[i]
            vectors = model.vector[at]
            s = x @ vectors
            z = model.weight[at] @ x + 0.5 * (s @ s - (x * x) @ (vectors * vectors).sum(1))
            slope = weight[y] * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
            decay = np.where(at < k, DECAY, WORD_DECAY)
            gw = slope * x + decay * model.weight[at]
            gv = slope * (x[:, None] * s[None, :] - vectors * (x * x)[:, None]) + decay[:, None] * vectors
            past_w[at] += gw * gw
            past_v[at] += gv * gv
            model.weight[at] -= RATE * gw / np.sqrt(past_w[at])
            model.vector[at] -= RATE * gv / np.sqrt(past_v[at])
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model | None:
    return fit(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class, class_bytes, "n_chars" if "n_chars" in docs.columns else None))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``(id, score)`` for every row: the probability of label 1.  Null texts count as empty, a null length as the text's.

    Without a model (no labels, or one class only) every score is 1, so that nothing is rejected unlearned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        own, out = sent.value, []
        bucket = kept("quality", lambda _: True, dict)
        for text, length in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own is None:
                out.append(1.0)
                continue
            at, x = inputs(text, length, bucket)
            z = raw_score(own, at, _scaled(own, x))
            out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
        return {"id": batch.column(0), "score": pa.array(out, pa.float64())}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(length_col).cast("bigint").alias("length"))
    return map_batches(rows, work, f"id {kind}, score double", 500)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: fit outside the held-out fold, score every document."""
    found = score(docs, train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), (fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
