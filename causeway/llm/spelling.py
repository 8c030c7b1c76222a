"""Spelling variants: words one edit apart, found by an index of variable-length grams.

Words are framed by a start and an end mark.  A dictionary says which grams are so frequent that they are extended: from every
place of a word the gram grows from two characters on for as long as it is in the dictionary, to ``LONGEST`` at most.  So rare grams stay
short and no list of words under a gram gets long only because its gram says little.

A gram depends on its own characters alone, so one edit affects just the grams that it touches.  Of grams that do not overlap it
affects one at most: merging the lists of two such grams misses no word within one edit.  A word's lists are the two
whose grams are rarest together (``_choose``).  An unaffected gram lies where it lay, or one place further in the longer of two words;
lists are kept by gram, place and length of word.  As the edit lies before or behind an unaffected gram, what is on the other side
of it is equal: a posting has checksums of both sides, and where one agrees the edit distance decides, inside the join.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import map_batches
from causeway.plans.durable import discard, written

RUN = r"[A-Za-zÀ-ÿ]"
#: Words have so many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Length of grams in code points.  Two grams of a framed word that don't overlap must exist: LONGEST + SHORTEST <= LEAST_LENGTH + 2.
SHORTEST, LONGEST = 2, 5
#: A gram is extended if more than this share of all words' grams have it (and more than LEAST_FREQUENT): so there are fewer of them than
#: FREQUENT_SHARE times the grams that start at one place of a word, whatever the corpus.
FREQUENT_SHARE, LEAST_FREQUENT = 1 << 17, 24
START, END = "^", "$"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, run)``: every maximal run of at least ``LEAST_LENGTH`` letters in every whole text, A-Z in lower case.

    Null and empty texts have none; repeated rows count again; a null id stays null.
    """
    each = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN + "{%d,}" % LEAST_LENGTH), F.lit(0)))
    return docs.select(F.col(id_col).alias("id"), each.alias("run")).withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def misspelled(found: DataFrame, one_in: int = 97) -> Column:
    """The run, or where ``one_in`` divides the crc32 of ``<id>:<run>`` (a null id is empty) the run without its code point at that crc32 modulo its length."""
    h = F.crc32(F.concat(F.coalesce(found["id"].cast("string"), F.lit("")), F.lit(":"), found["run"]).cast("binary"))
    at = F.pmod(h, F.char_length(found["run"]).cast("bigint")).cast("int")
    run = found["run"]
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(found: DataFrame, word: Column) -> DataFrame:
    """``(word, n)``: distinct words that are long and frequent enough."""
    n = found.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= LEAST_COUNT)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The dictionary: grams to extend, and how many places of words have them.

    Counted by Spark over all words; what reaches the driver is bounded by the share that a gram must have.
    """
    framed = F.concat(F.lit(START), "word", F.lit(END))
    total = words.agg(F.coalesce(F.sum(F.char_length("word")), F.lit(0))).first()[0]
    places = words.select(framed.alias("framed")).select("framed", F.explode(F.sequence(F.lit(1), F.char_length("framed") - (SHORTEST - 1))).alias("at"))
    grams = [F.when(F.col("at") + q - 1 <= F.char_length("framed"), F.substring("framed", F.col("at"), F.lit(q))) for q in range(SHORTEST, LONGEST + 1)]
    counts = places.select(F.explode(F.array(*grams)).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count("*").alias("n"))
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") > max(LEAST_FREQUENT, total // FREQUENT_SHARE)).toLocalIterator()}


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """``(gram, place)`` for every place of the framed word at which a gram starts."""
    framed = START + word + END
    out = []
    for at in range(len(framed) - SHORTEST + 1):
        end = at + SHORTEST
        while end < len(framed) and end - at < LONGEST and framed[at:end] in frequent:
            end += 1
        out.append((framed[at:end], at))
    return out


def affected(grams: list[tuple[str, int]]) -> int:
    """How many of these grams one edit can affect: the most that share a character."""
    return max((sum(at <= e < at + len(gram) for gram, at in grams) for e in {at for _, at in grams}), default=0)


def _choose(grams: list[tuple[str, int]], frequent: dict[str, int]) -> list[tuple[str, int]]:
    """Of the pairs of grams of which one edit affects one at most, the pair that fewest words have."""
    size = [frequent.get(gram, LEAST_FREQUENT // 2) for gram, _ in grams]
    least, best = None, ()
    # From the right: the rarest gram that starts at a place or later.
    rarest = [0] * (len(grams) + 1)
    rarest[-1] = -1
    for j in range(len(grams) - 1, -1, -1):
        k = rarest[j + 1]
        rarest[j] = j if k < 0 or size[j] <= size[k] else k
    for i, (gram, at) in enumerate(grams):
        j = rarest[min(at + len(gram), len(grams))]
        if j >= 0 and (least is None or size[i] + size[j] < least):
            least, best = size[i] + size[j], (grams[i], grams[j])
    return list(best)


def index(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """``(gram, place, size, before, behind, word, n, asks)``: the lists that hold each word, and (``asks``) those that it has to look through.

    A word is held under all its grams, and looks through two lists of words of its own size and four of words of one more.
    """
    held = words.sparkSession.sparkContext.broadcast(frequent)

    def work(batch: pa.RecordBatch) -> dict:
        dictionary = held.value
        rows = []
        for i, word in enumerate(batch.column(0).to_pylist()):
            grams, length, framed = decompose(word, dictionary), len(word), START + word + END
            sides = [(zlib.crc32(framed[:at].encode()), zlib.crc32(framed[at + len(g) :].encode())) for g, at in grams]
            rows += [(g, at, length, *sides[at], i, False) for g, at in grams]
            rows += [(g, at + shift, length + longer, *sides[at], i, True) for g, at in _choose(grams, dictionary) for shift, longer in ((0, 0), (0, 1), (1, 1))]
        gram, place, size, before, behind, row, asks = zip(*rows, strict=True) if rows else [()] * 7
        taken = batch.take(pa.array(row, pa.int32()))
        numbers = {"place": pa.array(place, pa.int32()), "size": pa.array(size, pa.int32()), "before": pa.array(before, pa.int64()), "behind": pa.array(behind, pa.int64())}
        return numbers | {"gram": pa.array(gram, pa.string()), "word": taken.column(0), "n": taken.column(1), "asks": pa.array(asks, pa.bool_())}

    return map_batches(words.select("word", "n"), work, "gram string, place int, size int, before bigint, behind bigint, word string, n bigint, asks boolean")


def near_words(words: DataFrame, frequent: dict[str, int] | None = None) -> DataFrame:
    """``(word, n, near, near_n)``: each pair of words that differ by exactly one inserted, deleted or replaced code point once; ``near`` is the later or longer one.

    A pair may come from both lists, and then comes twice.
    """
    lists = written(index(words, frequent_grams(words) if frequent is None else frequent), "gram-lists")
    ask = lists.where("asks").select("gram", "place", "size", "before", "behind", "word", "n")
    hold = lists.where("not asks").select("gram", "place", "size", F.col("before").alias("before2"), F.col("behind").alias("behind2"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    side = (F.col("before") == F.col("before2")) | (F.col("behind") == F.col("behind2"))
    once = (F.char_length("word") < F.col("size")) | (F.col("word") < F.col("near"))
    return ask.join(hold, ["gram", "place", "size"]).where(side & once & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")


def group(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words`` (word, n), whose words are distinct and of ``LEAST_LENGTH`` code points at least.

    The form is the near word with the largest n (of equals, the first in code-point order) if that n is at least twice the word's own; the root is
    where the forms lead.  A word without a form is its own root.  No words give no rows; other columns are left out.
    """
    words = written(words.select("word", "n"), "words")
    pairs = near_words(words)
    flipped = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    # A word has some thousands of neighbours at most (every place, every letter), so grouping by word has no hot key.
    each = pairs.unionByName(flipped).unionByName(alone).repartition("word").groupBy("word", "n", "near", "near_n").agg(F.lit(1).alias("_one"))
    best = each.groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    forms = written(best.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(forms.where("form is not null").select("word", "form"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms (word, form) lead.

    Each round looks up the pointer of the pointer.  As n doubles at least with every form, six rounds reach the end whatever the corpus.
    """
    spark = forms.sparkSession
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        done = moved.where("moved").isEmpty()
        discard(spark, at)
        at = moved.select("word", "root")
        if done:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`group` of the words of all texts, with one run in 97 misspelled on purpose (see :func:`misspelled`)."""
    found = runs(docs, id_col, text_col)
    return group(counted(found, misspelled(found)))
