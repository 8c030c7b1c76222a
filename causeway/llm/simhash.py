"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into four segments, each padded to the 23 bits of the perfect
Golay code.  Every word lies within three bits of exactly one codeword.  Of two words that differ in one bit one has odd
parity, and the codeword nearest to the other is nearest to it too, or to it with one bit flipped; so an even segment has the index of one
codeword and an odd one those of several.  Three differing bits leave one segment equal and one bit in each other, or two equal and
one bit at most in a third.  So a fingerprint is filed under one whole segment with indices for two others (40 bits), and under two
whole segments with indices for one other (44 bits): about 80 keys.  What meets under a key is
verified by its differing bits, and linked fingerprints are joined into components.

Keys are counted first, so only shared ones are looked at again.  Under a key every fingerprint is held against the smallest and
the largest, and then only fingerprints that are not yet in one component against each other, so that a dense group isn't paired with itself.
Equal fingerprints are one row from the start, so that groups of copies cost nothing.

:func:`keep_one` serves shingle similarity, whose pairs differ in more bits than Golay keys can bridge (at a similarity of 0.8 about
ten of 64): keys of a second kind, minima of shingle hashes, find those, and all links are verified on the shingle sets themselves.
A key that many texts share would pair them all, so these are told apart by their differences from one text among them (:func:`_met_in_crowds`).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from causeway.llm.common import batched, free_name, map_batches, member_words, members, salted_lookup
from causeway.llm.common import kept as held
from causeway.plans.components import connected_components
from causeway.plans.durable import written

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Generator polynomial of the binary Golay code of length 23 (fixed value), and the code's sizes.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11
#: Bits of a segment, and how many there are.
SEGMENT, SEGMENTS = 16, 4
#: Similarity of shingle sets, and the shingles' words, from which :func:`keep_one` links.
WORDS, SIMILARITY = 5, 0.8
#: Minima in one key of the second kind; their number follows from the share of similar pairs that may be missed.
ROWS, MISSED = 6, 5e-6
#: Words of 64 bits in a wide fingerprint, and sets too small to be judged by one.
WIDE, SMALL_SET = 16, 9
#: Texts under a key that are held against each other pair by pair; more of them go by their differences.
CROWD = 16


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of the word shingles, one for a text of fewer words; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = [e + i for i, e in enumerate(accumulate(map(len, found)))]
    starts = [0] + [e + 1 for e in ends[:-1]]
    h = xxhash.xxh64_intdigest
    if len(found) < words:
        return [h(joined, SEED)]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """A bit is set if it is in over half the XXH64 of the word shingles; without words, zero."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


@functools.lru_cache(1)
def _leaders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, and the error of at most three bits behind each syndrome."""
    step = np.zeros(LENGTH, np.int64)
    for bit in range(LENGTH):
        value = 1 << bit
        for top in range(bit, CHECKS - 1, -1):
            if value >> top & 1:
                value ^= GENERATOR << (top - CHECKS)
        step[bit] = value

    def of(bits: int, first: int) -> np.ndarray:
        table = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            table[1 << i : 2 << i] = table[: 1 << i] ^ step[first + i]
        return table

    low, high, leader = of(12, 0), of(11, 12), np.zeros(1 << CHECKS, np.int64)
    for n in range(4):
        for bits in combinations(range(LENGTH), n):
            leader[functools.reduce(lambda x, b: x ^ int(step[b]), bits, 0)] = sum(1 << b for b in bits)
    return low, high, leader


def nearest(word: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword within three bits of each 23-bit word."""
    low, high, leader = _leaders()
    return (word ^ leader[low[word & 4095] ^ high[word >> 12]]) >> CHECKS


def codewords(word: np.ndarray, bits: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """For each word the index of the nearest codeword, and for odd words the other indices one flipped bit away (-1 fills up)."""
    base = nearest(word)
    found = np.sort(nearest(word[:, None] ^ (1 << np.arange(bits, dtype=np.int64))[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found[(found == base[:, None]) | (np.bitwise_count(word) % 2 == 0)[:, None]] = -1
    return base, -np.sort(-found, axis=1)[:, : int((found >= 0).sum(1).max(initial=0))]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: the segments that are taken whole, and codeword indices of others."""
    whole = [((prints >> np.uint64(SEGMENT * i)) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64) for i in range(SEGMENTS)]
    fuzzy = [codewords(w) for w in whole]
    kinds = [((i,), tuple(j for j in range(SEGMENTS) if j != i)[:2]) for i in range(SEGMENTS)]
    kinds += [(pair, (i,)) for i in range(SEGMENTS) for pair in combinations([j for j in range(SEGMENTS) if j != i], 2)]
    rows, keys = [], []
    for number, (equal, near) in enumerate(kinds):
        at, key = np.arange(len(prints)), np.full(len(prints), number, np.int64)
        for i in equal:
            key = key << SEGMENT | whole[i]
        for i in near:
            every = np.concatenate((fuzzy[i][0][:, None], fuzzy[i][1]), axis=1)[at]
            which, _ = np.nonzero(every >= 0)
            at, key = at[which], (key[:, None] << 12 | every)[every >= 0]
        rows.append(at)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``(id, print bigint)``: every row's fingerprint as a signed 64-bit integer.  Null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "print": pa.array(prints.view(np.int64))}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, print bigint")


def _ends(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _shared(filed: DataFrame, who: str) -> DataFrame:
    """``(key, who, low, high)`` of the keys that several have; counting is combined before the shuffle, and Spark splits a hot key's join.

    Filed rows are many times those that they were made from, which Spark's sizes don't show; the hint keeps it from sending either side to every executor.
    """
    several = filed.groupBy("key").agg(F.min(who).alias("low"), F.max(who).alias("high")).where("low < high")
    return filed.join(several.hint("merge"), "key")


def _to_leaders(shared: DataFrame, who: str) -> DataFrame:
    """``(a, b)``: everyone under a key with the smallest and the largest there."""
    both = shared.select(who, F.explode(F.array("low", "high")).alias("leader")).where(F.col(who) != F.col("leader"))
    return both.select(*_ends(F.col(who), F.col("leader")))


def _apart(shared: DataFrame, found: DataFrame, who: str) -> DataFrame:
    """``(key, who, component)`` under keys where more than one component meets, by the links found so far."""
    labels = connected_components(found).withColumnRenamed("node", who)
    named = shared.select("key", who).join(labels, who, "left").withColumn("component", F.coalesce("component", who))
    several = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    return named.join(several, "key", "left_semi")


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of distinct fingerprints in column ``print`` that differ in three bits at most, enough of them for the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 1000):
                part = own[at : at + 1000]
                row, key = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "print"])

    # A small table lies in few files; its keys are many.
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = written(_shared(prints.select("print").repartition(partitions).mapInArrow(run, "key bigint, print bigint"), "print"), "shared-codewords")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    found = written(_to_leaders(shared, "print").where(close).distinct(), "links")
    apart = written(_apart(shared, found, "print"), "apart")
    if apart.isEmpty():
        return found
    x, y = (apart.select("key", F.col("print").alias(n), F.col("component").alias(f"c{n}")) for n in "ab")
    rest = x.join(y, (x.key == y.key) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "b").distinct()
    return found.unionByName(written(rest, "links"))


def _classes(marks: DataFrame) -> DataFrame:
    """``(print, least, component)``: distinct fingerprints, the smallest id that has each, and a fingerprint naming the component."""
    distinct = written(marks.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    grouped = connected_components(links(distinct)).withColumnRenamed("node", "print")
    return distinct.join(grouped, "print", "left").select("print", "least", F.coalesce("component", "print").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """``(id, print, component_id)``: each row's fingerprint and the smallest id it can reach over links.

    Rows without words have fingerprint zero and are linked like any other.  Repeated rows give repeated rows.
    Null ids never become a component's id unless it has no other.  An empty table gives no rows.
    """
    marks = written(fingerprints(docs, id_col, text_col, words), "prints")
    own = _classes(marks)
    smallest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = own.join(smallest, "component").select("print", "component_id")
    return salted_lookup(marks, named, ["print"], F.col("id")).select("id", "print", "component_id")


def digest(text: str | None) -> int:
    """A signed hash of the words."""
    found = xxhash.xxh3_64_intdigest(b" ".join((text or "").encode().lower().split()))
    return found - (1 << 64) if found >> 63 else found


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; one for a text without words."""
    return np.unique(np.array(shingle_hashes(text, words) or [0], np.uint64))


def resembles(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def bands(similarity: float) -> int:
    """Keys of ``ROWS`` minima that a set needs, so that of pairs that similar a share of ``MISSED`` at most has none in common."""
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-(min(similarity, 1 - 1e-9) ** ROWS))))


@functools.lru_cache(4)
def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(seed)
    return rnd.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rnd.integers(0, 1 << 63, n, dtype=np.uint64)


def _mixed(x: np.ndarray, factor: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Other hashes of hashes, a row for each factor."""
    v = x[None, :] * factor[:, None]
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x9E3779B97F4A7C15)
    return v ^ other[:, None]


def band_keys(own: np.ndarray, number: int) -> np.ndarray:
    """The set's keys: hashes of ``ROWS`` minima each."""
    factor, other = _factors(ROWS * number, 17)
    least = np.full(ROWS * number, ~np.uint64(0))
    for at in range(0, len(own), 512):
        np.minimum(least, _mixed(own[at : at + 512], factor, other).min(1), out=least)
    least = least.reshape(number, ROWS)
    key = np.arange(number, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """A fingerprint of ``64 * WIDE`` bits of a set of hashes."""
    factor, other = _factors(WIDE, 23)
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(own), 512):
        counts += np.unpackbits(np.ascontiguousarray(_mixed(own[at : at + 512], factor, other).T).view(np.uint8).reshape(-1, 8 * WIDE), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(own)).view(np.int64)


def wide_limit(similarity: float) -> int:
    """Bits in which wide fingerprints of sets that similar differ at most, but for one pair in a million."""
    share, bits = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE
    return math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share)))


def _similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs of digests ``(a, b)`` whose shingle sets are similar."""
    left, right = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = functools.lru_cache(64)(lambda text: shingles(text, words))
        for batch in batched(100, batches):
            met = [resembles(cut(x), cut(y), similarity) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(met, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _texts_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(digest, text)`` of the digests in ``wanted``; most other rows are left out before the shuffle."""
    words = docs.sparkSession.sparkContext.broadcast(member_words(wanted, "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(500, batches):
            own = np.array([digest(t) for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0)], names=["digest", "text"]).filter(pa.array(members(words.value, own)))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest bigint, text string")
    return found.groupBy("digest").agg(F.first("text", ignorenulls=True).alias("text")).join(wanted, "digest", "left_semi")


def similar_links(docs: DataFrame, texts: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """``(a, b)``: pairs of digests in ``texts`` (digest, print, keys) whose shingle sets are similar, enough of them for the components.

    Candidates: fingerprints three bits apart by Golay keys, equal fingerprints, and sets that share a key of minima.
    """
    leaders = texts.groupBy("print").agg(F.min("digest").alias("leader"))
    near = links(leaders).join(leaders.withColumnsRenamed({"print": "a", "leader": "da"}), "a").join(leaders.withColumnsRenamed({"print": "b", "leader": "db"}), "b")
    same = salted_lookup(texts.select("digest", "print"), leaders, ["print"], F.col("digest")).where("digest <> leader")
    shared = written(_shared(texts.select("digest", F.explode("keys").alias("key")), "digest"), "shared-minima")
    tried = near.select(*_ends(F.col("da"), F.col("db"))).unionByName(same.select(*_ends(F.col("digest"), F.col("leader")))).unionByName(_to_leaders(shared, "digest"))
    tried = written(tried.distinct(), "pairs")
    wanted = tried.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    own = written(_texts_of(docs, text_col, wanted), "near-texts")
    found = written(_similar(tried, own, words, similarity), "links")
    apart = written(_apart(shared, found, "digest"), "apart")
    if apart.isEmpty():
        return found

    count = apart.groupBy("key").count()
    several = written(apart.join(count.where(F.col("count") <= CROWD).select("key"), "key", "left_semi"), "apart")
    met = _met_by_twos(several, own, words, similarity)
    linked, crowded = _met_in_crowds(apart.join(count.where(F.col("count") > CROWD).select("key"), "key", "left_semi"), found, own, words, similarity)
    others = met.unionByName(crowded).distinct().join(tried, ["a", "b"], "left_anti")
    return found.unionByName(linked).unionByName(written(_similar(written(others, "pairs"), own, words, similarity), "links"))


def _met_by_twos(apart: DataFrame, own: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(a, b)``: pairs under a key of ``apart`` (key, digest, component) in two components whose sizes and wide fingerprints allow a link."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
        wide = pa.array([wide_fingerprint(s) for s in sets], pa.list_(pa.int64()))
        return {"digest": batch.column(0), "size": pa.array([len(s) for s in sets], pa.int32()), "wide": wide}

    told = map_batches(own.join(apart.select("digest").distinct(), "digest", "left_semi").select("digest", "text"), work, "digest bigint, size int, wide array<bigint>", 200)
    known = written(apart.join(written(told, "wide-prints"), "digest"), "apart")
    x, y = (known.select("key", *(F.col(c).alias(f"{c}_{n}") for c in ("digest", "component", "size", "wide"))) for n in "xy")
    bits = sum((F.bit_count(F.col("wide_x")[i].bitwiseXOR(F.col("wide_y")[i])) for i in range(WIDE)), F.lit(0))
    small, large = F.least("size_x", "size_y"), F.greatest("size_x", "size_y")
    fits = (small >= similarity * large - 1e-9) & ((small < SMALL_SET) | (bits <= wide_limit(similarity)))
    met = x.join(y, (x.key == y.key) & (F.col("digest_x") < F.col("digest_y")) & (F.col("component_x") != F.col("component_y")) & fits)
    return met.select(F.col("digest_x").alias("a"), F.col("digest_y").alias("b")).distinct()


def _crowds(apart: DataFrame, found: DataFrame) -> DataFrame:
    """``(pivot, digest, component)``: the texts under the keys whose largest component is the same, and its text with most links."""
    degree = found.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").count()
    ranked = apart.select("digest", "component").distinct().join(degree, "digest", "left")
    hubs = ranked.groupBy("component").agg(F.max(F.struct(F.coalesce("count", F.lit(0)), "digest")).alias("m")).select(F.col("component").alias("crowd"), F.col("m.digest").alias("pivot"))
    largest = apart.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component")).alias("m")).select("key", F.col("m.component").alias("crowd"))
    named = apart.join(largest, "key").groupBy("crowd", "digest").agg(F.first("component").alias("component"))
    return salted_lookup(named, hubs, ["crowd"], F.col("digest"), "inner").select("pivot", "digest", "component")


def _differences(crowds: DataFrame, own: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(pivot, digest, component, size, alone, diff)``: how each text's shingle set differs from the pivot's.

    ``alone`` counts differences that no other text here has, ``diff`` lists the others.  A text is left out if too many of its shingles occur
    nowhere else: it resembles none of the others.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        return {"digest": batch.column(0), "own": pa.array([shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(n)], names=["shingle", "n"])

    wanted = crowds.select(F.explode(F.array("pivot", "digest")).alias("digest")).distinct()
    sets = written(map_batches(own.join(wanted, "digest", "left_semi").select("digest", "text"), cut, "digest bigint, own array<bigint>", 200), "crowd-sets")
    common = sets.select("own").mapInArrow(counted, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    known = sets.sparkSession.sparkContext.broadcast(member_words(common, "shingle"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(100, batches):
            size, alone, diff = [], [], []
            for x, p in zip(batch.column("own"), batch.column("base"), strict=True):
                x, p = x.values.to_numpy(), p.values.to_numpy()
                added = np.setdiff1d(x, p, assume_unique=True)
                met = members(known.value, added)
                size.append(len(x))
                alone.append(int((~met).sum()))
                diff.append(np.concatenate((added[met], np.setdiff1d(p, x, assume_unique=True))))
            n, r = np.array(size, np.int64), np.array(alone, np.int64)
            out = batch.select(["pivot", "digest", "component"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(n), pa.array(r), pa.array(diff, pa.list_(pa.int64()))], names=[*out.schema.names, "size", "alone", "diff"]).filter(pa.array(n - r >= similarity * n - 1e-6))

    bases = sets.select(F.col("digest").alias("pivot"), F.col("own").alias("base")).join(crowds.select("pivot").distinct(), "pivot", "left_semi")
    both = salted_lookup(crowds.join(sets, "digest"), bases, ["pivot"], F.col("digest"), "inner").select("pivot", "digest", "component", "own", "base")
    return both.mapInArrow(work, "pivot bigint, digest bigint, component bigint, size bigint, alone bigint, diff array<bigint>")


def _met_in_crowds(apart: DataFrame, found: DataFrame, own: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` twice: links for the components, and pairs that may be links, so that no link between components under the keys of ``apart`` is lost.

    Texts x and y differ from a pivot in the shingles X and Y, and from each other in |X| + |Y| - 2 |X & Y|, which a similarity limits to
    a share of their sizes.  With ``w`` = |X| less that share of x's own size, x and y are alike just if |X & Y| >= (w_x + w_y) / 2.  So the text
    of least w is linked to whatever it makes no more than 0 with, and this links all such pairs.  All others must have differences in common:
    of so many that they meet in the first few, the rarest coming first (prefix and positional filtering).  Near copies have little in common
    of how they differ, so few are paired; as a text has only so many places to differ in, these few still grow faster than the texts.
    """
    spark = apart.sparkSession
    apart = written(apart, "crowded-keys")
    if apart.isEmpty():
        none = spark.createDataFrame([], "a bigint, b bigint")
        return none, none
    share, eps = (1 - similarity) / (1 + similarity), 1e-6
    f = F.size("diff").cast("double")
    told = _differences(written(_crowds(apart, found), "crowds"), own, words, similarity)
    told = written(told.withColumns({"f": f, "w": f + F.col("alone") - share * F.col("size"), "q": share * F.col("size") - F.col("alone")}), "differences")

    def attached(rows: DataFrame, small: DataFrame) -> DataFrame:
        return salted_lookup(rows, small, ["pivot"], F.col("digest"), "inner").drop("_salt")

    # X & Y has no more than f_y shingles, so w_x <= f_y + q_y, and the other way round.
    steps = told.groupBy("pivot", F.floor("w").alias("at")).agg(F.max(F.col("f") + F.col("q")).alias("top")).groupBy("pivot").agg(F.collect_list(F.struct("at", "top")).alias("steps"))
    least = told.groupBy("pivot").agg(F.min(F.struct("w", "digest", "component")).alias("least"))
    told = attached(told, steps.join(least, "pivot"))
    touched = F.col("w") + F.col("least.w") <= 1e-9
    told = written(told.where(touched | F.exists("steps", lambda s: (s["at"] <= F.col("f") + F.col("q") + eps) & (s["top"] >= F.col("w") - eps))).drop("steps"), "differences")
    linked = written(told.where(touched & (F.col("digest") != F.col("least.digest"))).select(*_ends(F.col("digest"), F.col("least.digest")), "component", F.col("least.component").alias("other")), "links")
    joined = connected_components(linked.where("component <> other").select("component", "other").distinct(), "component", "other")
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    told = salted_lookup(told.drop("least"), joined, ["component"], F.col("digest")).withColumn("component", F.coalesce("joined", "component")).drop("joined", "_salt")
    told = written(told, "differences")

    # Bounds by what the other components have: the smallest w, the largest q.
    each = told.groupBy("pivot", "component").agg(F.min("w").alias("w"), F.max("q").alias("q"))
    first = each.groupBy("pivot").agg(F.min(F.struct("w", "component")).alias("low"), F.max(F.struct("q", "component")).alias("high"))
    second = each.join(first, "pivot").groupBy("pivot", "low", "high").agg(
        F.min(F.when(F.col("component") != F.col("low.component"), F.col("w"))).alias("low2"), F.max(F.when(F.col("component") != F.col("high.component"), F.col("q"))).alias("high2")
    )
    told = attached(told, second.where("low2 is not null"))
    w = F.when(F.col("component") == F.col("low.component"), F.col("low2")).otherwise(F.col("low.w"))
    q = F.when(F.col("component") == F.col("high.component"), F.col("high2")).otherwise(F.col("high.q"))
    needed = F.greatest(F.lit(1.0), F.ceil((F.col("w") + w) / 2 - eps).cast("double"), F.ceil(F.col("w") - q - eps).cast("double"))
    told = told.withColumn("first", F.col("f") - needed + 1).where("first >= 1")
    each = written(told.select("pivot", "digest", "component", "f", "w", "q", "first", F.explode("diff").alias("shingle")), "differing")
    rank = F.row_number().over(Window.partitionBy("pivot", "digest").orderBy("n", "shingle"))
    ranked = each.join(each.groupBy("pivot", "shingle").agg(F.count("*").alias("n")), ["pivot", "shingle"]).withColumn("rank", rank)
    early = written(ranked.where("rank <= first and n > 1").select("pivot", "shingle", "digest", "component", "f", "w", "q", "rank"), "prefixes")
    x, y = (early.select("pivot", "shingle", *(F.col(c).alias(f"{c}_{n}") for c in ("digest", "component", "f", "w", "q", "rank"))) for n in "xy")
    fits = F.abs(F.col("f_x") - F.col("f_y")) <= F.col("q_x") + F.col("q_y") + eps
    left = 1 + F.least(F.col("f_x") - F.col("rank_x"), F.col("f_y") - F.col("rank_y")) >= (F.col("w_x") + F.col("w_y")) / 2 - eps
    met = x.join(y, (x.pivot == y.pivot) & (x.shingle == y.shingle) & (F.col("digest_x") < F.col("digest_y")) & (F.col("component_x") != F.col("component_y")) & fits & left)
    return linked.select("a", "b").distinct(), met.select(F.col("digest_x").alias("a"), F.col("digest_y").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Of each component of texts with a shingle similarity of ``similarity`` or more one row of ``docs``, that with the smallest id.

    All columns stay.  Of repeated rows with that id one stays; a null id counts as the largest.  Texts without words are alike.
    Rows whose text nobody shares or resembles are told by a filter of fixed size and take part in no shuffle.
    """
    number = bands(similarity)

    def work(batch: pa.RecordBatch) -> dict:
        held("simhash", lambda _: True, dict)  # lets go of what another stage kept
        texts = batch.column(1).to_pylist()
        keys = pa.array([band_keys(shingles(t, words), number) for t in texts], pa.list_(pa.int64()))
        prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        return {"id": batch.column(0), "digest": np.array([digest(t) for t in texts], np.int64), "print": prints, "keys": keys}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = map_batches(rows, work, f"id {docs.schema[id_col].dataType.simpleString()}, digest bigint, print bigint, keys array<bigint>", 200)
    own = F.struct("print", "keys")
    texts = marks.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first(own).alias("own"))
    texts = written(texts.select("digest", "least", "n", "own.print", "own.keys"), "distinct-texts")
    labels = connected_components(similar_links(docs, texts.select("digest", "print", "keys"), text_col, words, similarity)).withColumnRenamed("node", "digest")
    classes = texts.select("digest", "least", "n").join(labels, "digest", "left").withColumn("linked", F.col("component").isNotNull())
    rank = F.struct(F.col("least").isNull(), "least", "digest")
    chosen = classes.groupBy(F.coalesce("component", "digest").alias("component")).agg(F.min(rank).alias("m"), F.max("linked").alias("linked"), F.max("n").alias("n"))
    touched = written(classes.where("linked or n > 1").select("digest"), "touched")
    kept = written(chosen.where("linked or n > 1").select(F.col("m.least").alias("kept_id"), F.col("m.digest").alias("kept_digest")), "kept")

    name = free_name(docs, "digest")
    words_sent = docs.sparkSession.sparkContext.broadcast(member_words(touched, "digest"))

    def marked(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batched(500, batches):
                found = np.array([digest(t) for t in batch.column(text_col).to_pylist()], np.int64)
                yield batch.append_column(name, pa.array(found)).filter(pa.array(members(words_sent.value, found) == inside))

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))

    met = marked(True)
    copies = met.join(kept, (met[name] == kept.kept_digest) & met[id_col].eqNullSafe(kept.kept_id), "left_semi").dropDuplicates([id_col, name])
    # The filter lets some through that nobody touched.
    alone = met.join(touched.withColumnRenamed("digest", free_name(docs, "touched")), met[name] == F.col(free_name(docs, "touched")), "left_anti")
    return marked(False).unionByName(copies).unionByName(alone).select(*docs.columns)


def hexed(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def components(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), hexed("print").alias("fingerprint"), "component_id")
