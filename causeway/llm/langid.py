"""Language identification by unigram piece models, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary.  The probability of a
word is the sum over all its segmentations into pieces of their product, which a forward
pass over the word's positions gives; that of a text is the product over its words.  Probabilities are
fitted by expectation-maximisation: forward and backward sums give each piece's expected count.  Sums are rescaled along the way,
so that words may have any length.

All passes work on the distinct words of a batch at once: a trie of the vocabulary, held in
arrays, finds the pieces at every position, and one array step a position adds their sums up.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import IntMap, filter_batches, fold_of, kept, map_batches

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: What a language is fitted on: expected number of documents and of their bytes (chosen by a hash of the id), and languages at most
#: (the most frequent ones).
TRAIN_DOCS, TRAIN_BYTES, LANGUAGES = 300, 2 << 20, 256
#: Rounds of expectation-maximisation.
ROUNDS = 4
#: Positions after which sums are rescaled.
RESCALE = 8
SMOOTHING, UNKNOWN = 0.01, 1e-7
#: Words, and characters of words, whose scores a Python worker keeps; emptied when full.
CACHE_WORDS, CACHE_CHARS = 150_000, 3_000_000
#: Characters of the words whose lattices are built at once (one word at least).
LATTICE_CHARS = 40_000
FOLDS, HELD_OUT = 4, 2
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, whole; none if there is no letter."""
    runs = _RUN.findall((text or "").lower())
    return runs if any(any(map(str.isalpha, r)) for r in runs) else []


class Pieces:
    """The vocabulary as a trie: a map of (state, letter) to the next state."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.names = [p for p in kept if p == p.lower() and (p.strip(MARK).isalpha() or p == MARK)]
        letters = sorted({c for p in self.names for c in p})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width, self.depth = len(letters) + 1, max(map(len, self.names))
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(self.names):
            state = 0
            for c in piece:
                state = steps.setdefault(state * self.width + int(self.letter[ord(c)]), len(steps) + 1)
            ends[state] = number
        self.piece_at = np.full(len(steps) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.step = IntMap(steps)

    @property
    def size(self) -> int:
        """Number of pieces; the number itself stands for an unknown character."""
        return len(self.names)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (from node, to node, piece) sorted by end position and node, those positions, and each word's first node."""
        marked = [MARK + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        chars = self.letter[np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)]
        first = np.concatenate(([0], np.cumsum(lengths + 1)))
        local = np.arange(chars.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - local
        node = np.repeat(first[:-1], lengths) + local
        active, state = np.arange(chars.size), np.zeros(chars.size, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(chars.size, bool)
        for k in range(1, self.depth + 1):
            active, state = active[left[active] >= k], state[left[active] >= k]
            letter = chars[active + k - 1]
            state = self.step.get(np.where(letter > 0, state * self.width + letter, -1)).astype(np.int64)
            active, state = active[state > 0], state[state > 0]
            if not active.size:
                break
            piece = self.piece_at[state]
            hit = piece >= 0
            found.append((active[hit], np.full(int(hit.sum()), k), piece[hit]))
            if k == 1:
                single[active[hit]] = True
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(lone.size, np.int64), np.full(lone.size, self.size, np.int32)))
        at, k, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        end = local[at] + k
        order = np.lexsort((node[at], end))
        at, k, piece, end = at[order], k[order], piece[order], end[order]
        return node[at], node[at] + k, piece, end, first


def _sums(first: np.ndarray, depth: int, a: np.ndarray, b: np.ndarray, piece: np.ndarray, bounds: np.ndarray, p: np.ndarray, ascending: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per node and language, the sum over paths from a word's start (or to its end), as a number and the log of its scale.

    ``bounds`` has the edges of each position; edges go from a to b.  Every few positions a word's latest nodes are scaled so
    that the last one has sum 1.  Edges reach back ``depth`` nodes at most, so those share one scale whenever an edge is followed.
    """
    n_nodes, length = int(first[-1]), np.diff(first) - 1
    total, scale = np.zeros((n_nodes, p.shape[1])), np.zeros((n_nodes, p.shape[1]))
    total[first[:-1] if ascending else first[1:] - 1] = 1.0
    step = 1 if ascending else -1
    steps = range(len(bounds) - 1)
    for s in steps if ascending else reversed(steps):
        x, y = bounds[s], bounds[s + 1]
        if x < y:
            value = total[a[x:y]] * p[piece[x:y]]
            order = np.argsort(b[x:y], kind="stable")
            target = b[x:y][order]
            heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            own = target[heads]
            total[own] += np.add.reduceat(value[order], heads, axis=0)
            scale[own] = scale[own - step]
        if s % RESCALE == RESCALE - 1:
            place = s + 1 if ascending else s
            open_ = np.flatnonzero(length > place)
            now = first[open_] + place
            factor = total[now]
            for k in range(depth):
                here = (place >= k) & (place <= length[open_]) if ascending else place + k <= length[open_]
                if not here.any():
                    break
                at, part = (now - step * k)[here], factor[here]
                total[at] /= part
                scale[at] += np.log(part)
    return total, scale


@dataclass
class Model:
    languages: list[str]
    probability: np.ndarray  # pieces and the unknown character by languages, float64


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def score_words(p: np.ndarray, vocabulary: Pieces, words: list[str]) -> np.ndarray:
    """Log probability of each word under each language."""
    if not words:
        return np.zeros((0, p.shape[1]))
    a, b, piece, end, first = vocabulary.lattice(words)
    bounds = np.searchsorted(end, np.arange(1, int(end[-1]) + 2))
    total, scale = _sums(first, vocabulary.depth, a, b, piece, bounds, p, True)
    return np.log(total[first[1:] - 1]) + scale[first[1:] - 1]


def _parts(words: list[str]) -> list[list[str]]:
    """The words in parts of about ``LATTICE_CHARS`` characters, short words together so that passes end together."""
    words = sorted(words, key=len)
    parts: list[list[str]] = [[]]
    chars = 0
    for w in words:
        if chars + len(w) > LATTICE_CHARS and parts[-1]:
            parts.append([])
            chars = 0
        parts[-1].append(w)
        chars += len(w) + 2
    return parts


def expected_counts(p: np.ndarray, vocabulary: Pieces, words: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words by their probability; ``p`` is one language's."""
    a, b, piece, end, first = vocabulary.lattice(words)
    word = np.searchsorted(first, a, side="right") - 1
    start = a - first[word]
    forward_bounds = np.searchsorted(end, np.arange(1, int(end[-1]) + 2))
    back = np.argsort(start, kind="stable")
    back_bounds = np.searchsorted(start[back], np.arange(0, int(start.max()) + 2))
    ahead, up = _sums(first, vocabulary.depth, a, b, piece, forward_bounds, p, True)
    behind, down = _sums(first, vocabulary.depth, b[back], a[back], piece[back], back_bounds, p, False)
    last = first[1:] - 1
    whole, over = ahead[last, 0], up[last, 0]
    share = ahead[a, 0] * p[piece, 0] * behind[b, 0] / whole[word] * np.exp(np.minimum(up[a, 0] + down[b, 0] - over[word], 600.0))
    return np.bincount(piece, times[word] * share, minlength=vocabulary.size + 1)


def fit(counts: dict[str, dict[str, int]], path: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its word counts."""
    vocabulary = pieces(path)
    languages = sorted(counts)
    columns = []
    for language in languages:
        p = np.full((vocabulary.size + 1, 1), 1.0 / vocabulary.size)
        parts = [(x, np.array([counts[language][w] for w in x], float)) for x in _parts(sorted(counts[language])) if x]
        for _ in range(rounds if parts else 0):
            mass = sum(expected_counts(p, vocabulary, x, times) for x, times in parts) + SMOOTHING
            p = (mass / mass.sum())[:, None]
        p[-1] = UNKNOWN
        columns.append(p[:, 0])
    return Model(languages, np.stack(columns, axis=1) if columns else np.zeros((vocabulary.size + 1, 0)))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, language_bytes: int = TRAIN_BYTES, most: int = LANGUAGES, path: str | None = None
) -> Model:
    """Fit on labelled documents that aren't held out: of each of the ``most`` most frequent languages about ``per_language``, or fewer of ``language_bytes`` together.

    Texts over an eighth of ``language_bytes`` are passed over.  Languages are counted over all rows; Spark counts the sample's
    words, so that the driver gets word counts of a bounded amount of text.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.where(fold_of(id_col, FOLDS) != HELD_OUT).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") <= language_bytes // 8))
    found = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not found:
        return Model([], np.zeros((pieces(path).size + 1, 0)))
    sizes = {r["lang"]: min(per_language / r["n"], language_bytes / max(1, r["bytes"])) for r in found}
    share = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))

    def work(batch: pa.RecordBatch) -> dict:
        both = [(lang, w) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in words_of(text)]
        return {"lang": pa.array([x for x, _ in both], pa.string()), "word": pa.array([x for _, x in both], pa.string())}

    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in map_batches(drawn.select("text", "lang"), work, "lang string, word string", 100).groupBy("lang", "word").count().collect():
        counts[r["lang"]][r["word"]] = r["count"]
    return fit(counts, path)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, lang_pred, score)``: the likeliest language of each whole text and its posterior under equal priors.

    ``und`` and score 0 where the text is null or has no letter, or where nothing was learned.  Repeated rows give repeated rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        own = sent.value
        found = _scorer(path, own).scores(batch.column(1).to_pylist()) if own.languages else [None] * batch.num_rows
        names, scores = [], []
        for x in found:
            names.append("und" if x is None else own.languages[int(x.argmax())])
            scores.append(0.0 if x is None else float(1.0 / np.exp(x - x.max()).sum()))
        return {"id": batch.column(0), "lang_pred": names, "score": pa.array(scores, pa.float64())}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, lang_pred string, score double", 300)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that have a language, with the predicted one in ``lang_col``; other columns stay.

    Rows whose text is null or has no letter go.  Where nothing was learned, rows with letters stay as they are.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> tuple[pa.Array, dict]:
        own, texts = sent.value, batch.column(0).to_pylist()
        if not own.languages:
            return pa.array([bool(words_of(t)) for t in texts], pa.bool_()), {}
        scorer = _scorer(path, own)
        found = scorer.scores(texts)
        names = [None if x is None else own.languages[int(x.argmax())] for x in found]
        return pa.array([x is not None for x in found], pa.bool_()), {lang_col: pa.array(names, pa.string())}

    return filter_batches(docs, [text_col], work, 300)


class _Scorer:
    def __init__(self, path: str, model: Model):
        self.pieces, self.model = pieces(path), model
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.chars = 0
        self.logs = np.zeros((1024, len(self.model.languages)))

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probabilities of each text under every language; None for one without letters.  New words are scored together."""
        cut = [words_of(t) for t in texts]
        if len(self.row) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        row = self.row
        for part in _parts(list({w for words in cut for w in words if w not in row})):
            n = len(row)
            while n + len(part) > len(self.logs):
                self.logs = np.concatenate((self.logs, np.zeros_like(self.logs)))
            self.logs[n : n + len(part)] = score_words(self.model.probability, self.pieces, part)
            row.update(zip(part, range(n, n + len(part)), strict=True))
            self.chars += sum(map(len, part))
        return [self.logs[np.fromiter(map(row.__getitem__, words), np.int64, len(words))].sum(0) if words else None for words in cut]


def _scorer(path: str, model: Model) -> _Scorer:
    return kept("langid", lambda s: s.model is model, lambda: _Scorer(path, model))


def identify(docs: DataFrame) -> DataFrame:
    """The contract's columns: fit on the folds that aren't held out, predict every document."""
    model = train(docs)
    found = predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold_of("id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
