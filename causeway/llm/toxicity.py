"""Toxicity by compression distance to zstandard dictionaries of toxic and of ordinary text.

Windows are pieces of the lower-cased text in UTF-8, overlapping and cut at any byte.  A window's distance is its
compressed length with a dictionary trained on windows of ordinary text less that with one trained on windows of toxic text.  Several
pairs of dictionaries are trained on different windows; what one pair finds by chance the others don't.  The first pair is
asked about every window, the others about those that it finds ``GATE`` bytes nearer to toxic text; a window's distance is the sum,
and 0 for windows below the gate.  A text's features are how many of its windows reach each of several thresholds.  Thresholds are
quantiles over ordinary texts, and a logistic calibration turns features into a score; both come from labelled texts that no
dictionary is trained on.

Toxic texts are mostly ordinary, so their windows are narrowed: texts are dealt into two halves, each half's dictionaries
rank the other half's windows, and the next dictionary is trained on those that fit the toxic one better than nearly all ordinary
windows do, then on shorter pieces of them.  Ranking across halves is what keeps a window from being chosen because the dictionary
holds itself.  The ordinary dictionary is trained on the ordinary windows that the toxic one fits best.  Both lie behind one base
dictionary of ordinary text, so that what they have in common costs the same on either side.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import LabelledSample, filter_batches, fold_of, kept, labelled_sample, map_batches

FOLDS, HELD_OUT = 5, 0
#: Labelled texts of each class that are fitted on, at most, and bytes of all of them.
PER_CLASS, CLASS_BYTES = 1000, 4 << 20
#: Bytes of the base dictionary.
BASE_BYTES = 32 << 10
#: Narrowing: bytes of a window, bytes of the dictionaries, rounds, and the share of ordinary windows that a kept one must exceed.
STAGES = ((64, 3072, 3, 0.98), (32, 2048, 3, 0.97), (24, 2048, 2, 0.95))
#: Windows that a dictionary is trained on at least.
LEAST_WINDOWS = 40
#: The trainer's unit in bytes, for each of the pairs that a half gives.
UNITS = (8, 8, 6)
#: Bytes of a scored window, of its step to the next, and the first pair's distance from which the others are asked.
WINDOW, STEP, GATE = 40, 24, 2
#: Windows of a text that are cut at once.
WINDOWS_AT_ONCE = 10_000
#: Quantiles of ordinary windows' distances that become the thresholds.
THRESHOLDS = (0.97, 0.99, 0.997, 0.999, 0.9997)
#: What ends the header of a trained dictionary (fixed value of its format); its content follows.
REPEATS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"
CUT = 0.5


def windows_of(text: str | None, size: int | None = None, step: int | None = None) -> list[bytes]:
    """Windows of the whole text, the last one cut short; none of an empty text."""
    return [w for part in _window_parts(text, size or WINDOW, step or STEP) for w in part]


def _window_parts(text: str | None, size: int, step: int) -> Iterator[list[bytes]]:
    """The windows of a text, so many at a time that a very long text needs little besides itself."""
    raw = (text or "").lower().encode()
    starts = range(0, max(min(len(raw), 1), len(raw) - size + step), step)
    for at in range(0, len(starts), WINDOWS_AT_ONCE):
        yield [raw[a : a + size] for a in starts[at : at + WINDOWS_AT_ONCE]]


@dataclass
class Model:
    """Pairs of dictionaries (toxic, ordinary) and a calibration; it travels to the executors as plain bytes and numbers."""

    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    thresholds: list[int] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    @property
    def usable(self) -> bool:
        return bool(self.weights)


def _compressor(raw: bytes):
    """Frames of nothing but the block, by a binary-tree matcher that looks for five bytes at least: shorter matches are chance."""
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


class Distance:
    """Compressed length with the ordinary dictionary less that with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def of(self, windows: list[bytes]) -> np.ndarray:
        a, b = self.ordinary, self.toxic
        return np.fromiter((len(a(w)) - len(b(w)) for w in windows), np.int64, len(windows))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.each = model, [Distance(*p) for p in model.pairs]

    def distances(self, text: str | None) -> np.ndarray:
        """The distance of every window of the whole text."""
        parts = [self._of(windows) for windows in _window_parts(text, WINDOW, STEP)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _of(self, windows: list[bytes]) -> np.ndarray:
        out = self.each[0].of(windows)
        at = np.flatnonzero(out >= GATE)
        out[out < GATE] = 0
        near = [windows[i] for i in at]
        for pair in self.each[1:]:
            out[at] += pair.of(near)
        return out

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.model.weights, features(self.distances(text), self.model.thresholds), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def features(distances: np.ndarray, thresholds: list[int]) -> list[float]:
    """Shares and counts of the windows at or above each threshold."""
    hits = [int((distances >= t).sum()) for t in thresholds]
    return [1.0, *(math.log1p(100.0 * h / (distances.size + 10.0)) for h in hits), *(math.log1p(h) for h in hits)]


def _dictionary(size: int, windows: list[bytes], unit: int = 8) -> bytes:
    """The content of a dictionary trained on the windows, repeated where there are too few to train on; empty where that fails."""
    windows = windows * max(1, -(-3000 // max(1, len(windows))))
    try:
        whole = zstandard.train_dictionary(size + 256, windows, k=20 if size <= 2048 else 24, d=unit).as_bytes()
    except zstandard.ZstdError:
        return b""
    return whole.partition(REPEATS)[2][-size:]


def _share(text: str, parts: int) -> int:
    return zlib.crc32(text.encode()) % parts


def _pieces(windows: list[bytes], size: int, step: int) -> list[bytes]:
    return [w[a : a + size] for w in windows for a in range(0, max(1, len(w) - size + 1), step)]


def narrowed(toxic: list[str], ordinary: list[str]) -> list[tuple[bytes, bytes]]:
    """Pairs of dictionaries, each with the base before it, from texts of both classes; none where there are too few."""
    size = STAGES[0][0]
    cut = lambda texts: [w for t in texts for w in windows_of(t, size, size // 2)]
    base = _dictionary(BASE_BYTES, cut(t for t in ordinary if _share(t, 3) == 2))
    pool = [[cut(t for t in texts if _share(t, parts) == k) for k in (0, 1)] for texts, parts in ((toxic, 2), (ordinary, 3))]
    chosen = [list(pool[0]), list(pool[1])]
    if not base or min(len(w) for side in pool for w in side) < LEAST_WINDOWS:
        return []
    for number, (size, trained, rounds, quantile) in enumerate(STAGES):
        if number:
            pool = [[_pieces(w, size, size // 4) for w in chosen[0]], [_pieces(w[::2], size, size // 2) for w in pool[1]]]
        for _ in range(rounds):
            following: list[list] = [[[], []], [[], []]]
            for k in (0, 1):
                even = chosen[1][k][:: max(1, len(chosen[1][k]) // max(1, len(chosen[0][k])))]
                pair = _dictionary(trained, chosen[0][k]), _dictionary(trained, even)
                if not all(pair):
                    return []
                distance = Distance(base + pair[0], base + pair[1])
                found, usual = distance.of(pool[0][1 - k]), distance.of(pool[1][1 - k])
                keep = np.flatnonzero(found > np.quantile(usual, quantile))
                following[0][1 - k] = [pool[0][1 - k][i] for i in keep]
                following[1][1 - k] = [pool[1][1 - k][i] for i in np.argsort(-usual, kind="stable")[: len(keep)]]
            if min(map(len, following[0])) < LEAST_WINDOWS:
                break
            chosen = following
    pairs = [[_dictionary(trained, chosen[side][k][part :: len(UNITS)], unit) for side in (0, 1)] for part, unit in enumerate(UNITS) for k in (0, 1)]
    return [(base + a, base + b) for a, b in pairs if a and b]


def fit(sample: LabelledSample) -> Model:
    """Dictionaries from three quarters of the labelled texts, thresholds and calibration from the rest.

    An unusable model where a class is missing or has too few texts.
    """
    held = [(t, y) for t, y in sample.rows if not zlib.crc32(b"fit" + t.encode()) % 4]
    train = [(t, y) for t, y in sample.rows if zlib.crc32(b"fit" + t.encode()) % 4]
    if len({y for _, y in held}) < 2:
        return Model()
    model = Model(narrowed([t for t, y in train if y], [t for t, y in train if not y]))
    if not model.pairs:
        return model
    scorer = Scorer(model)
    found = [scorer.distances(t) for t, _ in held]
    usual = np.concatenate([d for d, (_, y) in zip(found, held, strict=True) if not y])
    if not usual.size:
        return model
    # Distances are whole bytes: a threshold is the next whole one above its quantile, and all differ.
    for q in THRESHOLDS:
        model.thresholds.append(max(int(np.quantile(usual, q)) + 1, model.thresholds[-1] + 1 if model.thresholds else 1))
    x = np.array([features(d, model.thresholds) for d in found])
    y = np.array([label for _, label in held], float)
    model.weights = _logistic(x, y, np.array([sample.weight[int(v)] for v in y])).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's method for weighted logistic regression with a small ridge on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class, class_bytes))
def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row; null texts count as empty.  Without a usable model every score is 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(sent.value) if sent.value.usable else None
        return {"id": batch.column(0), "score": pa.array([scorer.score(t) if scorer else 0.0 for t in batch.column(1).to_pylist()], pa.float64())}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, score double", 500)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, with all their columns.  Without a usable model, all rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> tuple[pa.Array, dict]:
        scorer = _scorer(sent.value) if sent.value.usable else None
        return pa.array([scorer is None or scorer.score(t) < cut for t in batch.column(0).to_pylist()], pa.bool_()), {}

    return filter_batches(docs, [text_col], work)


def _scorer(model: Model) -> Scorer:
    return kept("toxicity", lambda s: s.model is model, lambda: Scorer(model))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: fit outside the held-out fold, score every document."""
    found = score(docs, train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), (fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
