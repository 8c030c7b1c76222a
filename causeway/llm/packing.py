"""Sum-of-squares online packing of tokenised documents into windows.

Every document is turned into ids and an end id.  Whole windows are cut off; what remains is
placed online: into the fill level that makes the sum over levels of squared counts of
partially filled windows smallest (a new window counts as level 0).  The counts lie in a
level array, so a placement costs one pass over that array.

Each task packs its own rows, with no shuffle.  At a task's end the level array is emptied: from the highest level down, windows get
their exact room cut off what lies on the lowest (documents may be cut freely).  The one window that is left becomes
windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import batched, kept

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 2048
END_ID = 1
#: Below this code point the two tokenizer libraries' character classes agree.
COMMON = "ɐ"
#: Texts of more characters go through the library: the rank table's word rule runs out of stack on a million blanks in a row.
LONG = 100_000


class ByteBpe:
    """Ids of texts by the ``tokenizers`` vocabulary, without the special tokens that it would put around a text.

    Texts of common characters go through the same vocabulary's rank table, which gives equal ids
    four times as fast; for other characters the libraries' character classes may differ.  Texts in which an
    added token is spelled out have its id there, as the library has it, and go through the library; so do very long ones.
    """

    def __init__(self, vocabulary: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.paths = (vocabulary, ranks)
        self.whole = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        plain = len(text) <= LONG and (text.isascii() or max(text) < COMMON) and not any(t in text for t in self.added)
        ids = self.fast.encode_ordinary(text) if plain else self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def tokenizer(vocabulary: str, ranks: str) -> ByteBpe:
    """The tokenizer of these files, kept from task to task."""
    return kept("packing", lambda t: t.paths == (vocabulary, ranks), lambda: ByteBpe(vocabulary, ranks))


class Packer:
    """Windows of ``size`` tokens; ``put`` and ``close`` return finished windows as lists of (document, start, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(size)]

    def level_for(self, n: int) -> int:
        """The level (0: a new window) whose growth by ``n`` least raises the sum of squares; of equals, the fullest."""
        below, count = self.size - n, self.count
        best, level = 2 * count[n] + 1, 0
        if below > 0:
            change = 2 * (count[n + 1 : self.size + 1] - count[1 : below + 1]) + 2
            change[-1] = 1 - 2 * count[below]  # a full window leaves the array
            change[count[1 : below + 1] == 0] = 1 << 40
            back = int(np.argmin(change[::-1]))
            if change[below - 1 - back] <= best:
                level = below - back
        return level

    def put(self, document: object, start: int, ids: bytes) -> list[list]:
        n = len(ids) // 4
        if n == self.size:
            return [[(document, start, ids)]]
        level = self.level_for(n)
        window = self.at[level].pop() if level else []
        if level:
            self.count[level] -= 1
        window.append((document, start, ids))
        if level + n == self.size:
            return [window]
        self.at[level + n].append(window)
        self.count[level + n] += 1
        return []

    def close(self) -> list[list]:
        """Empty the level array: fill each window from the highest level down with what lies on the lowest; the last one is cut at powers of two."""
        left = [(level, window) for level in range(self.size - 1, 0, -1) for window in self.at[level]]
        self.__init__(self.size)
        done, low, high = [], 0, len(left) - 1
        while low < high:
            level, window = left[low]
            room = self.size - level
            while room and low < high:
                below, donor = left[high]
                document, start, ids = donor.pop()
                taken = min(room, len(ids) // 4)
                window.append((document, start, ids[: 4 * taken]))
                if 4 * taken < len(ids):
                    donor.append((document, start + taken, ids[4 * taken :]))
                room -= taken
                left[high] = (below - taken, donor)
                if not donor:
                    high -= 1
            if room:
                left[low] = (self.size - room, window)
            else:
                done.append(window)
                low += 1
        return done + (self._powers(left[low][1]) if low == high else [])

    def _powers(self, pieces: list) -> list[list]:
        """The pieces of one window as windows whose lengths are falling powers of two."""
        pieces, total = pieces[::-1], sum(len(ids) // 4 for *_, ids in pieces)
        windows = []
        for room in (1 << b for b in range(self.size.bit_length(), -1, -1) if total >> b & 1):
            window = []
            while room:
                document, start, ids = pieces.pop()
                taken = min(room, len(ids) // 4)
                window.append((document, start, ids[: 4 * taken]))
                if 4 * taken < len(ids):
                    pieces.append((document, start + taken, ids[4 * taken :]))
                room -= taken
            windows.append(window)
        return windows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length.

    A null or empty text has the end id alone.  Each row is a document of its own, also where ids
    repeat or are null.  An empty table gives no rows; other columns are left out.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = ranks or public_tokenizers.path(RANKS)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(vocabulary, ranks).encode, Packer(window)
        end = np.array([END_ID], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        id_type = None

        def rows(windows: list[list]) -> list[tuple]:
            nonlocal sequence
            out = []
            for one in windows:
                offset, total = 0, sum(len(ids) // 4 for _, _, ids in one)
                for (doc, tokens), start, ids in one:
                    out.append((doc, start, len(ids) // 4, ids, tokens, sequence, offset, total))
                    offset += len(ids) // 4
                sequence += 1
            return out

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batched(500, batches):
            id_type = batch.column(0).type
            done = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                whole = (doc, len(ids) // 4)
                for at in range(0, len(ids), 4 * window):
                    done += packer.put(whole, at // 4, ids[at : at + 4 * window])
            yield made(rows(done))
        if id_type is not None:
            yield made(rows(packer.close()))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def placements(docs: DataFrame) -> DataFrame:
    """The contract's columns: where each piece lies and the checksum of its ids."""
    return pack(docs).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length"
    )
