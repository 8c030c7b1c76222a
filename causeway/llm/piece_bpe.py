"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped (leading marker, spaces to markers) and cut into units that
no piece can cross.  The distinct units of a batch lie in one flat symbol
array.  Each round looks up the rank of every adjacent pair, takes the minimum
per unit, merges all leftmost non-overlapping occurrences of it at once and
compacts the arrays, until no unit has a pair left.

Merging at once equals the library's one-by-one order unless a merge makes a
pair that is at least as good as the merged one.  Units where that happens
(runs of spaces, mostly) are redone in strict order with a heap.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import IntMap, kept, map_batches

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Units whose ids a Python worker keeps; the store is emptied when full, so memory is bounded.
CACHE_UNITS = 300_000
_NO_PAIR = np.int64(1) << 40


class PieceBpe:
    """A BPE vocabulary with byte fallback, read from a SentencePiece model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        self.byte_id = {int(pieces[i][3:5], 16): i for i in byte_ids}
        self.surface = [pieces[i].replace(MARK, " ").encode() if pieces[i] in plain else b"" for i in range(size)]
        for value, i in self.byte_id.items():
            self.surface[i] = bytes([value])
        self.surface[self.unk] = " ⁇ ".encode()
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        self.rank_of = np.zeros(size, np.int64)
        for i in plain.values():
            self.rank_of[i] = order[model.get_score(i)]
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = {plain[p[:k]] * size + plain[p[k:]]: i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.size, self.pairs = size, pairs
        self.made = IntMap(pairs)
        known = "".join(re.escape(chr(c)) for c in np.flatnonzero(self.char_id >= 0).tolist() if chr(c).isspace())
        # A unit starts at a marker (none follows another character inside a piece) or at white space that no piece has.
        loose = "".join(c for c in "\n\t" if c not in known)
        self.unit = re.compile(f"{MARK}*[^{MARK}{loose}]+|{MARK}+|[{loose}]" if loose else f"{MARK}*[^{MARK}]+|{MARK}+")
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("the vocabulary has pieces that cross a word start")

    # -- encoding ---------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """The escaped text, cut where no piece can reach across; joined, they are the escaped text."""
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NO_PAIR`` where it makes no piece) and the piece it makes."""
        made = self.made.get(np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1))
        return np.where(made >= 0, self.rank_of[made], _NO_PAIR), made

    def _in_order(self, symbols: list[int]) -> list[int]:
        """One merge after the other, best rank first and leftmost among equals."""
        n = len(symbols)
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and symbols[a] >= 0 and symbols[b] >= 0:
                made = self.pairs.get(symbols[a] * self.size + symbols[b])
                if made is not None:
                    heapq.heappush(heap, (int(self.rank_of[made]), a, b, symbols[a], symbols[b], made))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, a, b, was_a, was_b, made = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or symbols[a] != was_a or symbols[b] != was_b:
                continue
            symbols[a], gone[b], after[a] = made, True, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [i for i in range(n) if not gone[i]]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers."""
        if not units:
            return []
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol, unit = self.char_id[chars].copy(), np.repeat(np.arange(len(units)), lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while symbol.size:
            left, right, inside = symbol[:-1], symbol[1:], unit[:-1] == unit[1:]
            rank, made = self._look_up(left, right)
            rank = np.append(np.where(inside, rank, _NO_PAIR), _NO_PAIR)
            starts = np.flatnonzero(np.append(True, ~inside))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, symbol.size)))
            open_ = least < _NO_PAIR
            if not open_.all():
                done.append((unit[~open_], symbol[~open_], chars[~open_]))
            if not open_.any():
                break
            hit = np.flatnonzero((rank == least) & open_)
            new_run = np.append(True, np.diff(hit) != 1)
            run_start = hit[np.maximum.accumulate(np.where(new_run, np.arange(hit.size), 0))]
            hit = hit[(hit - run_start) % 2 == 0]
            merged = symbol.copy()
            merged[hit] = made[hit]
            keep = open_.copy()
            keep[hit + 1] = False
            # Beside a merge, before and after the next one has been made: is there a pair as good as the merged one?
            better = np.zeros(len(units), bool)
            several = np.bincount(unit[hit], minlength=len(units)) > 1
            follow = hit[(hit + 2 < symbol.size)]
            follow = follow[unit[np.minimum(follow + 2, symbol.size - 1)] == unit[follow]]
            soon, _ = self._look_up(merged[follow], symbol[follow + 2])
            better[unit[follow[soon <= least[follow]]]] = True
            ahead = hit[hit > 0]
            ahead = ahead[unit[ahead - 1] == unit[ahead]]
            soon, _ = self._look_up(symbol[ahead - 1], merged[ahead])
            better[unit[ahead[soon <= least[ahead]]]] = True
            next_symbol, next_unit, next_chars = merged[keep], unit[keep], chars[keep]
            if next_symbol.size > 1:
                soon, _ = self._look_up(next_symbol[:-1], next_symbol[1:])
                level = least[keep][:-1]
                better[next_unit[:-1][(soon <= level) & (next_unit[:-1] == next_unit[1:])]] = True
            better &= several
            if better.any():
                for u in np.flatnonzero(better).tolist():
                    whole = np.frombuffer(units[u].encode("utf-32-le"), np.uint32).astype(np.int64)
                    own = self.char_id[whole].tolist()
                    kept = self._in_order(own)
                    done.append((np.full(len(kept), u), np.array([own[i] for i in kept], np.int32), whole[kept]))
                stay = ~better[next_unit]
                next_symbol, next_unit, next_chars = next_symbol[stay], next_unit[stay], next_chars[stay]
            symbol, unit, chars = next_symbol, next_unit, next_chars
        unit, symbol, chars = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(unit, kind="stable")
        unit, symbol, chars = unit[order], symbol[order], chars[order]
        ends = np.searchsorted(unit, np.arange(len(units) + 1))
        flat = symbol.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for u in np.unique(unit[symbol < 0]).tolist():
            a, b = ends[u], ends[u + 1]
            ids: list[int] = []
            for s, c in zip(symbol[a:b].tolist(), chars[a:b].tolist(), strict=True):
                ids += [s] if s >= 0 else [self.byte_id[x] for x in chr(c).encode()] if self.byte_id else [self.unk]
            out[u] = np.array(ids, "<u4").tobytes()
        return out

    def encode_batch(self, texts: list[str], store: dict[str, bytes]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian bytes; ``store`` keeps units seen before."""
        cut = [self.units(t) for t in texts]
        fresh = list({u for units in cut for u in units if u not in store})
        own = dict(zip(fresh, self.encode_units(fresh), strict=True))
        if len(store) + len(own) > CACHE_UNITS:
            kept = {u: store[u] for units in cut for u in units if u in store}
            store.clear()
            own |= kept
        store.update(own)
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        return [begin + b"".join(map(store.__getitem__, units)) + end for units in cut]

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian bytes): markers to spaces, byte pieces joined, the leading space dropped.

        Bytes that are no UTF-8 become U+FFFD one by one; begin and end ids give nothing.
        """
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = _lenient(raw)
        return text[1:] if text.startswith(" ") else text


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@functools.lru_cache(4)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids binary)``: every text's ids with begin and end ids, little-endian unsigned 32-bit.

    A null or empty text has the begin and end ids alone.  Repeated rows give repeated rows; an
    empty table gives an empty one; other columns are left out.  There is no shuffle.
    """
    path = path or public_tokenizers.path(MODEL)
    kind = docs.schema[id_col].dataType.simpleString()
    def work(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "ids": pa.array(model(path).encode_batch([t or "" for t in batch.column(1).to_pylist()], kept(f"units of {path}", lambda _: True, dict)), pa.binary())}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, ids binary", 500)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(id, ids, text)``: the text of each row of ids; null ids give empty text."""
    path = path or public_tokenizers.path(MODEL)
    kind = encoded.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "ids": batch.column(1), "text": [model(path).decode(i or b"") for i in batch.column(1).to_pylist()]}

    return map_batches(encoded.select("id", "ids"), work, f"id {kind}, ids binary, text string", 500)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: token counts and digests of ids and of the decoded text."""
    rows = decode(encode(docs, path=path), path)
    return rows.select(
        F.col("id").alias("doc_id"),
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )

