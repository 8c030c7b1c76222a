"""Exact document fingerprints after canonical folding.

A text is put into NFKC, case-folded, put into NFKC again and its white space runs become single spaces
(none at the ends).  The fingerprint is the 128-bit xxh3 of the result in UTF-8.  Documents are
grouped by fingerprint; inside a group of two or more the canonical bytes themselves are compared.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import batched, map_batches, salted_lookup
from causeway.plans.durable import written


def canonical(text: str | None) -> str:
    """The folded form of a text; of null or white space, the empty string."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split())
    return " ".join(text.lower().split())


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode())


def group_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, group_id, group_size)``: groups of rows with equal canonical bytes.

    ``group_id`` is the group's smallest id.  Null texts count as empty; repeated rows are members
    each.  Fingerprints are counted first; only texts whose fingerprint occurs twice or more are
    grouped by their bytes, with equal ones combined before the shuffle.  A group is one row in that shuffle
    for each task, however many members it has.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        folded = [canonical(t).encode() for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "fingerprint": [xxhash.xxh3_128_hexdigest(x) for x in folded], "folded": folded}

    rows = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, fingerprint string, folded binary")
    marks = written(rows.select("id", "fingerprint"), "fingerprints")
    several = marks.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    single = salted_lookup(marks, several, ["fingerprint"], F.col("id"), "left_anti").select("id", "fingerprint", F.col("id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"))
    # The distinct bytes under each fingerprint that occurs more than once; two kinds under one would be a collision.
    repeated = salted_lookup(rows, several, ["fingerprint"], F.col("id"), "left_semi").groupBy("fingerprint", "folded")
    kinds = written(repeated.agg(F.min("id").alias("group_id"), F.count("*").alias("group_size")).withColumn("folded", F.sha2("folded", 512)), "kinds")
    clashing = kinds.groupBy("fingerprint").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fingerprint")
    if clashing.isEmpty():
        grouped = salted_lookup(marks, kinds.drop("folded"), ["fingerprint"], F.col("id"), "inner")
    else:
        told = rows.withColumn("folded", F.sha2("folded", 512))
        grouped = salted_lookup(told, kinds, ["fingerprint", "folded"], F.col("id"), "inner")
    return single.unionByName(grouped.select("id", "fingerprint", "group_id", "group_size"))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OWN = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (1 if equal, else 0).

    The next document is the one that follows in descending doc_id (ties by a hash of the text, then by text; null ids last); after the
    last comes the first.  Rows are dealt by ranges of this order, in which repeated rows are told apart by a number, and sorted; each task walks its
    rows.  What a task can't know, the first text of the range after its own, is joined afterwards: one row a range.  A single
    row is its own next.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The number only spreads rows that are alike, so that it does not matter which of them gets which.
    dealt = rows.withColumns({"tie": F.xxhash64("text"), "number": F.pmod(F.monotonically_increasing_id(), F.lit(4096))})
    ranges = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = dealt.repartitionByRange(partitions, *ranges, "number").sortWithinPartitions(*ranges, "text").select("doc_id", "text")
    walked = written(dealt.mapInArrow(_walk, f"part int, role string, text string, {_OWN}"), "next")

    heads = walked.where("role = 'head'").select("part", F.col("text").alias("head_text"))
    # Ranges that have rows, each with the one after it; the last with the first.  One small row a range.
    parts = heads.select("part")
    first = parts.agg(F.min("part").alias("first"))
    order_of_parts = Window.orderBy("part")
    links = parts.withColumn("after", F.lead("part").over(order_of_parts)).crossJoin(F.broadcast(first)).select("part", F.coalesce("after", "first").alias("after"))
    last = walked.where("role = 'last'").select("part", "doc_id", "text").join(links, "part").join(heads.withColumnRenamed("part", "after"), "after")

    def finish(batch: pa.RecordBatch) -> dict:
        return _columns([_compare(i, t, n) for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    ends = map_batches(last.select("doc_id", "text", "head_text"), finish, _OWN, 100)
    return walked.where("role = 'done'").select(*ends.columns).unionByName(ends)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns, and each document's exact group (``group_id``, ``group_size``)."""
    groups = group_exact(docs).groupBy(F.col("id").alias("_id"), F.col("fingerprint").alias("_print")).agg(F.min("group_id").alias("group_id"), F.max("group_size").alias("group_size"))
    rows = compare_with_next(docs)
    return rows.join(groups, rows.doc_id.eqNullSafe(groups._id) & (rows.fingerprint == groups._print), "left").drop("_id", "_print")


def _compare(doc_id: int | None, text: str, following: str, own: str | None = None, other: str | None = None) -> tuple:
    edited = edited_text(text, following)
    own, other, changed = own or fingerprint(text), other or fingerprint(following), fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, float(own == changed), float(own == other)


_NAMES = [x.split()[0] for x in _OWN.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _columns(rows: list[tuple]) -> dict:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return {n: pa.array(c, t) for n, t, c in zip(_NAMES, _TYPES, columns, strict=True)}


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to finished rows, and the range's first text (``head``) and last row (``last``)."""
    part = TaskContext.get().partitionId()
    before = None

    def batch_of(role: str, text: str | None, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        own = _columns(rows)
        return pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "role": pa.array([role] * n, pa.string()), "text": pa.array([text] * n, pa.string()), **own})

    blank = (None,) * 6
    for batch in batched(500, batches):
        done = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = fingerprint(text)
            if before is None:
                yield batch_of("head", text, [(None, *blank)])
            else:
                done.append(_compare(before[0], before[1], text, before[2], own))
            before = (doc_id, text, own)
        yield batch_of("done", None, done)
    if before is not None:
        yield batch_of("last", before[1], [(before[0], *blank)])
