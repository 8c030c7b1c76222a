"""Byte-level BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that stand side by side inside no token of the vocabulary are a certain cut: no merge can ever join
them.  The pairs are a table of 65,536 bits read off the vocabulary.  A batch of texts becomes one byte array; it is cut at all certain cuts and
where the vocabulary's word rule starts a new word (found on arrays of character classes), so most cuts are both.  The fragments
between cuts are encoded independently, each distinct one once, and their ids are concatenated.

Within a fragment the merge of lowest rank goes first, leftmost among equals.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from causeway.llm.common import kept, map_batches

VOCABULARY = "byte_bpe_50k.json"
#: Fragments whose ids a Python worker keeps, and the longest that it keeps; the store is emptied when full, so memory is bounded.
STORE, STORED_BYTES = 300_000, 64
#: Characters of texts that one byte array holds, unless a single text is longer.
PART_CHARS = 1 << 20
LETTER, NUMBER, OTHER, SPACE, UNSEEN = range(5)
#: What the word rule splits off after an apostrophe that starts a word (fixed values).
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_of_char() -> dict[str, int]:
    """The byte that a character stands for in such a vocabulary: printable Latin-1 characters for themselves, U+0100 and up for the others in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary in the file format of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule, model = spec["pre_tokenizer"] or {}, spec["model"]
        fixed = model["type"] == "BPE" and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not spec["normalizer"]
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not fixed or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE")
        byte = _byte_of_char()
        raw = {i: bytes(byte[c] for c in token) for token, i in model["vocab"].items() if all(c in byte for c in token)}
        self.single = [0] * 256
        for i, b in raw.items():
            if len(b) == 1:
                self.single[b[0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [model["vocab"][a + b] for a, b in merges]
        self.rank = {model["vocab"][a] << 32 | model["vocab"][b]: r for r, (a, b) in enumerate(merges)}
        self.never = np.ones(1 << 16, bool)
        for b in raw.values():
            for x, y in zip(b, b[1:]):
                self.never[x << 8 | y] = False
        # Ids are looked up in one flat array of bytes when decoding.
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        raw |= {i: "".join(chr(byte[c]) if c in byte else c for c in t).encode("latin-1") if all(c in byte for c in t) else t.encode() for t, i in self.added.items()}
        self.length = np.zeros(max(raw) + 1, np.int64)
        for i, b in raw.items():
            self.length[i] = len(b)
        self.place = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.flat = np.frombuffer(b"".join(raw.get(i, b"") for i in range(len(self.length))), np.uint8)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kind = np.full(0x110000, UNSEEN, np.uint8)
        self.words = Tokenizer.from_file(path).pre_tokenizer

    # -- cutting ----------------------------------------------------------

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """Character classes.  Those of characters not met before are asked of the library, so that its Unicode tables count."""
        found = self.kind[codes]
        if (found == UNSEEN).any():
            for c in np.unique(codes[found == UNSEEN]).tolist():
                beside = [len(self.words.pre_tokenize_str(x + chr(c))) == 1 for x in "a1!"]
                self.kind[c] = beside.index(True) if any(beside) else SPACE
            found = self.kind[codes]
        return found

    def _word_starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words start; ``first`` marks the starts of texts.

        A word is a run of one class, with the blank before it.  Of white space before a word the last character stands apart (or is that
        blank); an apostrophe that starts a word takes one of the short endings alone.
        """
        kind = self._kinds(codes)
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        last = np.flatnonzero((kind[:-1] == SPACE) & run[1:] & ~first[1:])
        start[last] = True
        start[last[codes[last] == 0x20] + 1] = False
        quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & run[1:] & ~first[1:] & (kind[1:] == LETTER))
        end_of = np.append(np.flatnonzero(first)[1:], codes.size)
        for at, end in zip(quote.tolist(), end_of[np.searchsorted(end_of, quote, "right")].tolist(), strict=True):
            after = "".join(map(chr, codes[at + 1 : min(at + 3, end)].tolist()))
            ending = next((s for s in SHORT if after.startswith(s)), None)
            if ending:
                start[at + 1] = False
                if at + 1 + len(ending) < codes.size:
                    start[at + 1 + len(ending)] = True
        return start

    def fragments(self, texts: list[str]) -> list[list[bytes]]:
        """The fragments of each text; joined they are its UTF-8 bytes.  No text may be empty."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        first = np.zeros(codes.size, bool)
        first[0] = True
        first[ends[:-1]] = True
        start = self._word_starts(codes, first)
        flat = whole.encode()
        data = np.frombuffer(flat, np.uint8)
        if data.size == codes.size:
            cut = start
        else:
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            at = np.cumsum(width) - width
            cut = np.zeros(data.size, bool)
            cut[at[start]] = True
            ends = (at + width)[ends - 1]
        cut[1:] |= self.never[data[:-1].astype(np.uint16) << 8 | data[1:]]
        places = np.flatnonzero(cut)
        bounds = np.searchsorted(places, ends).tolist()
        starts = [*places.tolist(), data.size]
        pieces = [flat[a:b] for a, b in zip(starts, starts[1:])]
        return [pieces[a:b] for a, b in zip([0, *bounds], bounds)]

    # -- merging ----------------------------------------------------------

    def merge(self, fragment: bytes) -> bytes:
        """Ids of a fragment as little-endian unsigned 32-bit integers."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, none = self.rank, len(self.made)
        while len(ids) > 1:
            pairs = [rank.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            least = min(pairs)
            if least == none:
                break
            at = pairs.index(least)
            ids[at : at + 2] = [self.made[least]]
        return np.array(ids, "<u4").tobytes()

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same by a heap of rank and place; time grows little faster than the fragment."""
        n = len(ids)
        symbol, after, before = array("q", ids), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank = self.rank
        heap = [r << 40 | i for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            at, least = top & (1 << 40) - 1, top >> 40
            right = after[at]
            if symbol[at] < 0 or right >= n or rank.get(symbol[at] << 32 | symbol[right]) != least:
                continue
            symbol[at], symbol[right] = self.made[least], -1
            onward = after[at] = after[right]
            if onward < n:
                before[onward] = at
                r = rank.get(symbol[at] << 32 | symbol[onward])
                if r is not None:
                    heapq.heappush(heap, r << 40 | at)
            left = before[at]
            if left >= 0:
                r = rank.get(symbol[left] << 32 | symbol[at])
                if r is not None:
                    heapq.heappush(heap, r << 40 | left)
        out = np.frombuffer(symbol, np.int64)
        return out[out >= 0].astype("<u4").tobytes()

    def encode_batch(self, texts: list[str], store: dict[bytes, bytes]) -> list[bytes]:
        """Ids of each text as little-endian bytes; ``store`` keeps fragments met before.  Added tokens that a text spells out have their own ids."""
        out: list[list[bytes]] = [[] for _ in texts]
        plain: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            for part in self.split.split(text) if self.split else [text]:
                if part:
                    plain.append((i, part))
        at = 0
        while at < len(plain):
            size, to = 0, at
            while to < len(plain) and (to == at or size + len(plain[to][1]) <= PART_CHARS):
                size += len(plain[to][1])
                to += 1
            some, at = plain[at:to], to
            ordinary = [(i, part) for i, part in some if part not in self.added]
            cut = iter(self.fragments([part for _, part in ordinary]) if ordinary else [])
            for i, part in some:
                out[i].append(np.array([self.added[part]], "<u4").tobytes() if part in self.added else self._ids(next(cut), store))
        return [b"".join(ids) for ids in out]

    def _ids(self, pieces: list[bytes], store: dict[bytes, bytes]) -> bytes:
        try:
            return b"".join(map(store.__getitem__, pieces))
        except KeyError:
            pass
        own = {p: self.merge(p) for p in set(pieces) if p not in store}
        if len(store) + len(own) > STORE:
            own |= {p: store[p] for p in set(pieces) if p in store}
            store.clear()
        store.update((p, ids) for p, ids in own.items() if len(p) <= STORED_BYTES)
        return b"".join([own[p] if p in own else store[p] for p in pieces])

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes joined; what is no UTF-8 becomes U+FFFD."""
        length = self.length[ids]
        ends = np.cumsum(length)
        shift = np.repeat(self.place[ids] - ends + length, length)
        return self.flat[shift + np.arange(shift.size)].tobytes().decode("utf-8", "replace")


@functools.lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids array<int>)``: every text's ids, without special tokens around it.

    A null or empty text has no ids.  Repeated rows give repeated rows; an empty table gives an empty one; other columns are left
    out.  There is no shuffle.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        store = kept(f"fragments of {path}", lambda _: True, dict)
        ids = vocabulary(path).encode_batch([t or "" for t in batch.column(1).to_pylist()], store)
        offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
        return {"id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, ids array<int>", 500)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(id, ids, text)``: the text of each row of ids, added tokens spelled out; null ids give empty text."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        rows = batch.column(1)
        texts = [vocabulary(path).decode(rows[i].values.to_numpy() if rows[i].is_valid else np.zeros(0, np.int32)) for i in range(len(rows))]
        return {"id": batch.column(0), "ids": rows, "text": pa.array(texts, pa.string())}

    return map_batches(encoded.select("id", "ids"), work, f"id {kind}, ids array<int>, text string", 500)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: token counts and digests of ids and of the decoded text."""
    rows = decode(encode(docs, path=path), path)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
