"""Helpers the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.plans.durable import repeated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


@dataclass
class LabelledSample:
    """(text, 0 or 1) of some labelled documents, and for each class how many labelled documents one of them stands for."""

    rows: list[tuple[str, int]]
    lengths: list[int | None]
    weight: dict[int, float]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, class_bytes: int, length_col: str | None = None) -> LabelledSample:
    """Labelled documents outside the held-out fold: at most ``per_class`` and ``class_bytes`` bytes of text of each class.

    They are those with the smallest hash of the id; texts over a sixteenth of ``class_bytes`` are passed over.  Ids labelled more
    than once count once, with the largest label; null labels and texts are left out.  All labelled ids are counted, so that fits can
    weigh a class by its true share whatever the sample holds of it.
    """
    known = labels.where((fold_of("doc_id", folds) != held_out) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).where("label in (0, 1)")
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # Two top-k selections of per_class small rows bound what is sent to every executor.
    drawn = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    length = F.col(length_col).cast("bigint") if length_col else F.lit(None).cast("bigint")
    texts = docs.select("doc_id", "text", length.alias("length")).where(F.col("text").isNotNull() & (F.octet_length("text") <= class_bytes // 16))
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "length")).alias("own"), F.min("label").alias("label"))
    # The rows number 2 * per_class at most, so one window over each class is small.
    running = F.sum(F.octet_length("own.text")).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept_rows = found.withColumn("bytes", running).where(F.col("bytes") <= class_bytes)
    rows = sorted(((r["text"], r["label"], r["length"]) for r in kept_rows.select("own.text", "label", "own.length").collect()), key=lambda r: (r[0], r[1]))
    size = Counter(y for _, y, _ in rows)
    return LabelledSample([(t, y) for t, y, _ in rows], [n for *_, n in rows], {y: total[y] / n for y, n in size.items()})


#: Shares that the rows of one key are dealt into in a salted join.
SALTS = 32


def salted_lookup(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """``rows`` joined to ``small`` (one row a key), each key's rows dealt into SALTS shares by ``spread``.

    ``small`` is repeated once a share.  The share stays in column ``_salt``.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    each = repeated(small, "_salt", SALTS)
    return dealt.join(each, [*keys, "_salt"], how)


#: Words of 64 bits in a membership filter: 8 MB, whatever it is made from.  A filter of very many members lets everything through.
FILTER_WORDS = 1 << 20


def member_words(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each of the hashes in ``column``, by its low bits; grouped by Spark, at most ``FILTER_WORDS`` rows reach the driver."""
    k = F.col(column)
    found = keys.groupBy(F.shiftright(k, 6).bitwiseAND(FILTER_WORDS - 1).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def members(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter has each hash's bit."""
    own = hashes.view(np.uint64)
    return (words[((own >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)).astype(np.int64)] >> (own & np.uint64(63))) & np.uint64(1) == 1


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name = f"_{name}"
    return name


class IntMap:
    """A map of non-negative integers to integers in two arrays, looked up many keys at a time (open addressing)."""

    def __init__(self, pairs: dict[int, int]):
        self.slots = 1 << max(4, (8 * len(pairs)).bit_length())
        self.key, self.value = np.full(self.slots + 64, -1, np.int64), np.full(self.slots + 64, -1, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self._slot(keys), 0
        while keys.size:
            self.probes += 1
            free = self.key[at] < 0
            self.key[at[free]], self.value[at[free]] = keys[free], values[free]
            out = self.key[at] != keys
            keys, values, at = keys[out], values[out], at[out] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> np.int64(40)) & np.int64(self.slots - 1)

    def get(self, key: np.ndarray) -> np.ndarray:
        """The values of ``key``, -1 where there is none; negative keys have none."""
        at = self._slot(key)
        found = self.key[at]
        out = np.where((found == key) & (key >= 0), self.value[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        for step in range(1, self.probes):
            if not open_.size:
                break
            found = self.key[at[open_] + step]
            same = found == key[open_]
            out[open_[same]] = self.value[at[open_[same]] + step]
            open_ = open_[~same & (found >= 0)]
        return out


#: Rows that Spark hands to a Python worker at once; texts may be long.
ARROW_ROWS = 1000
_KEPT: dict[str, object] = {}


def kept(key: str, fits: Callable[[object], bool], make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task.  It holds one at a time, so stages do not add up."""
    found = _KEPT.get(key)
    if found is None or not fits(found):
        _KEPT.clear()
        release()
        found = _KEPT[key] = make()
    return found


def release() -> None:
    """Give freed memory of this process back to the system, so that what an earlier stage needed is not held through the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, whose default of 10,000 rows is made for numbers, not for texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def batched(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``rows`` rows, so that working arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1000) -> DataFrame:
    """``df`` through ``work``, which makes a dict of columns from a batch of at most ``rows`` rows."""
    small_batches(df.sparkSession)
    names = [f.name for f in _fields(df.sparkSession, schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(rows, batches):
            out = work(batch)
            yield pa.RecordBatch.from_arrays([_arrow(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, columns: list[str], work: Callable[[pa.RecordBatch], tuple[pa.Array, dict]], rows: int = 500) -> DataFrame:
    """``df`` without the rows that ``work`` rejects, and with the columns it replaces.

    ``work`` gets a batch of ``columns`` and returns a mask of rows to keep and new values by column name.
    """
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(rows, batches):
            kept, changed = work(batch.select(columns))
            arrays = [changed[n].cast(batch.schema.field(n).type) if n in changed else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(kept)

    return df.mapInArrow(run, df.schema)


def _arrow(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _fields(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields
