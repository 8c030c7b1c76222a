"""Personal data found by weak supervision, in DataFrame functions alone.

Patterns propose candidate spans.  Four labelers vote on each (for, against, or not at all): the
strict pattern check, a gazetteer, the words before it, and its borders.  Candidates are counted by votes and
features over the whole corpus; expectation-maximisation on those counts (some thousands at most, however large the
corpus) estimates each labeler's reliability and each vote pattern's probability, which are the soft labels
of a final logistic classifier.  It sees more than the votes: kind, length, the span's characters, how varied they are, and a hash of the
word before it.  Spans that pass the strict base checks always stay; the classifier adds others.

Work on a text is linear in its length and in its candidates: places and contexts come from the pieces between matches, and running
sums are made a block at a time.

Patterns are written so that Java's engine takes linear time and no recursion: repeats are possessive, and a run that failed
from its start isn't tried again from its middle.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.plans.durable import written

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "tel")
BASE = KINDS[:4]
LABELERS = ("strict", "gazetteer", "context", "border")
ROUNDS, STEPS = 25, 400
CONTEXT_CHARS = 24
#: Matches that a running sum takes at once, and buckets of the word before a span.
BLOCK, WORD_BUCKETS = 64, 16
#: What the classifier sees of a candidate besides kind and votes.
FEATURES = ("size", "shape", "variety", "word")

#: Candidate patterns.  Of the base kinds these are the contract's, in possessive form.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|bearer)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[a-z0-9+/_-]{8,}+",
    "tel": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: What a text must have for a pattern to be tried at all.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.contains("=") | t.contains(":"),
    "tel": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
}
#: Gazetteers (fixed values): domains' ends, card issuers' first digits, countries' dialling codes, reserved networks.
DOMAIN_ENDS = r"(?i)\.(com|org|net|edu|gov|info|io|co|de|fr|es|uk|us|eu|it|nl|ch|at|be|pl|br|mx|jp|cn|in|ca|au)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
DIALLING = r"^(1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
#: Words before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": r"(?i)(mail|contact|write|address|mailto)\W*$|<$",
    "ip": r"(?i)(\bip|host|server|address|node|from)\W*$",
    "card": r"(?i)(card|visa|mastercard|credit|debit|amex|payment)\W*(no|number)?\W*$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|contact|dial)\w*\W*$",
    "secret": r"[=:,;({\[\"'\s]$|^$",
    "tel": r"(?i)(tel|phone|call|fax|mobile|cell|contact|dial)\w*\W*$",
}
AGAINST = r"(?i)(isbn|issn|version|section|chapter|page|figure|table|order|invoice|serial|part|v)\W*$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Luhn's check of the digits of ``text``."""
    backwards = F.reverse(_digits(text))

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(backwards, at, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(at % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def _strict(kind: str, text: Column) -> Column:
    """Vote of the strict check: 1, -1, or 0 where there is nothing to check."""
    n = F.length(_digits(text))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    if kind == "email":
        holds = F.lit(True)
    elif kind == "ip":
        holds = text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    elif kind == "card":
        return F.when(n.between(14, 19), F.when(_luhn(text), 1).otherwise(-1)).otherwise(-1)
    elif kind == "phone":
        holds = n.between(10, 15)
    elif kind == "secret":
        mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
        return F.when(mixed & (F.length(text) >= 16), 1).when(mixed, 0).otherwise(-1)
    else:
        holds = text.rlike(r"^\(?[2-9]")
    return F.when(holds, 1).otherwise(-1)


def _gazetteer(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.when(text.rlike(DOMAIN_ENDS), 1).when(text.rlike(r"\.[^.]*[^A-Za-z.][^.]*$"), -1).otherwise(0)
    if kind == "ip":
        return F.when(text.rlike(RESERVED), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(text).rlike(ISSUERS), 1).otherwise(-1)
    if kind == "phone":
        return F.when(_digits(text).rlike(DIALLING), 1).otherwise(-1)
    if kind == "secret":
        return F.when(text.rlike(r"(?i)^(x+|example|changeme|password|placeholder|[a-z]+)$"), -1).otherwise(1)
    return F.lit(0)


def _found(kind: str, text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(GATES[kind](text), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(empty)


_PLACES = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _placed(found: Column, pieces: Column) -> Column:
    """Matches with their code-point places and what stands around them, from what lies between them.

    The context before a match reaches back over one other match at most.  Running sums are made within blocks of matches and over blocks.
    """
    n = F.size(found)
    blank = F.lit("")

    def own(i: Column) -> Column:
        piece, last = F.element_at(pieces, i), F.when(i > 1, F.concat(F.right(F.element_at(pieces, i - 1), F.lit(CONTEXT_CHARS)), F.element_at(found, i - 1))).otherwise(blank)
        match = F.element_at(found, i)
        before = F.right(F.concat(F.right(last, F.lit(CONTEXT_CHARS)), F.right(piece, F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
        following = F.concat(F.left(F.element_at(pieces, i + 1), F.lit(1)), F.when(i < n, F.left(F.element_at(found, F.least(i + 1, n)), F.lit(1))).otherwise(blank))
        return F.struct(F.length(piece).alias("gap"), F.length(match).alias("length"), match.alias("text"), before.alias("before"), F.left(following, F.lit(1)).alias("after"))

    each = F.transform(F.sequence(F.lit(1), n), own)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    none = F.array().cast("array<int>")

    def within(list_: Column) -> Column:
        def with_sums(all_: Column) -> Column:
            part = lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))
            totals = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0), lambda t, x: t + x["gap"] + x["length"]))
            begin = F.struct(F.lit(0).alias("pos"), none.alias("list"))
            firsts = F.aggregate(totals, begin, lambda s, t: F.struct((s["pos"] + t).alias("pos"), F.concat(s["list"], F.array(s["pos"])).alias("list")), lambda s: s["list"])

            def step(state: Column, x: Column) -> Column:
                start = state["pos"] + x["gap"]
                end = start + x["length"]
                row = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"), x["after"].alias("after"))
                return F.struct(end.alias("pos"), F.concat(state["list"], F.array(row)).alias("list"))

            def placed(k: Column, first: Column) -> Column:
                return F.aggregate(part(k), F.struct(first.alias("pos"), F.array().cast(_PLACES).alias("list")), step, lambda s: s["list"])

            return F.flatten(F.zip_with(blocks, firsts, placed))

        # A transform over one element names the array, so that it is made once.
        return F.element_at(F.transform(F.array(list_), with_sums), 1)

    return F.when(n > 0, within(each)).otherwise(F.array().cast(_PLACES))


def _entropy_class(value: Column) -> Column:
    """0 to 2: how many of the first 64 characters differ."""
    head = F.left(value, F.lit(64))
    share = F.size(F.array_distinct(F.split(head, ""))) / F.greatest(F.length(head), F.lit(1))
    return F.when(share < 0.35, 0).when(share < 0.65, 1).otherwise(2)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, text, pii)``: each row of ``docs`` as a struct, its text (null: empty), and an array of candidates.

    A candidate has kind, start, end, is_base, the labelers' votes and the classifier's features.  Positions count code points; ends are
    exclusive.  As the row lies in a struct, its columns may have any names.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumns({f"found_{k}": _found(k, text) for k in KINDS})
    rows = rows.withColumns({f"pieces_{k}": F.when(F.size(f"found_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in KINDS})
    rows = rows.withColumns({f"places_{k}": _placed(F.col(f"found_{k}"), F.col(f"pieces_{k}")) for k in KINDS})

    def judged(kind: str) -> Column:
        def one(place: Column) -> Column:
            value = F.regexp_extract(place["text"], r"([A-Za-z0-9+/_-]{8,})$", 1) if kind == "secret" else place["text"]
            start = place["end"] - F.length(value) if kind == "secret" else place["start"]
            before, after = place["before"], place["after"]
            strict = _strict(kind, value)
            context = F.when(before.rlike(AGAINST), -1).when(before.rlike(CUES[kind]), 1).otherwise(0)
            border = F.when(before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]"), -1).otherwise(1)
            size = F.length(value)
            shape = F.when(~value.rlike("[A-Za-z]"), 0).when(~value.rlike("[0-9]"), 1).when(value.rlike("^[a-f0-9]+$"), 2).otherwise(3)
            word = F.lower(F.regexp_extract(before, r"(\p{L}+)\W*$", 1))
            return F.struct(
                F.lit(kind).alias("kind"),
                F.lit(KINDS.index(kind)).alias("rank"),
                start.alias("start"),
                place["end"].alias("end"),
                (F.lit(kind in BASE) & (strict == 1)).alias("is_base"),
                F.when(size < 10, 0).when(size < 16, 1).when(size < 24, 2).otherwise(3).alias("size"),
                shape.alias("shape"),
                _entropy_class(value).alias("variety"),
                F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("int").alias("word"),
                strict.alias("strict"),
                _gazetteer(kind, value).alias("gazetteer"),
                context.alias("context"),
                border.alias("border"),
            )

        places = F.col(f"places_{kind}")
        if kind == "card":
            places = F.filter(places, lambda p: F.length(_digits(p["text"])) >= 12)
        return F.transform(places, one)

    return rows.select("row", "text", F.concat(*(judged(k) for k in KINDS)).alias("pii"))


@dataclass
class Model:
    """Labelers' reliabilities (probability of each vote for true and for false spans) and the classifier's weights."""

    reliability: dict[tuple[str, str, int], tuple[float, float]]
    weights: dict[str, float]


Pattern = tuple[str, tuple[int, ...], dict[str, int], int]


def features(kind: str, seen: tuple[int, ...], votes: dict[str, int]) -> list[str]:
    own = [f"{kind}:{name}={value}" for name, value in zip(FEATURES, seen, strict=True)]
    return ["bias", f"kind={kind}", *own, *(f"{k}={v}" for k, v in votes.items()), f"{kind}:strict={votes['strict']}"]


def fit(patterns: list[Pattern]) -> Model:
    """From (kind, features, votes, count): expectation-maximisation over vote patterns, then logistic regression on its posteriors.

    The start takes the majority of the votes for the truth; each kind has its own rates and its own share of true spans.
    """
    belief = {i: (0.9 if sum(v.values()) > 0 else 0.5 if sum(v.values()) == 0 else 0.1) for i, (_, _, v, _) in enumerate(patterns)}
    rates: dict[tuple[str, str, int], tuple[float, float]] = {}
    for _ in range(ROUNDS):
        mass: dict[tuple[str, str, int], list[float]] = defaultdict(lambda: [0.5, 0.5])
        whole: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        for i, (kind, _, votes, n) in enumerate(patterns):
            p = belief[i]
            whole[kind][0] += n * p
            whole[kind][1] += n * (1 - p)
            for name, vote in votes.items():
                mass[kind, name, vote][0] += n * p
                mass[kind, name, vote][1] += n * (1 - p)
        rates = {key: (a / (whole[key[0]][0] + 0.5), b / (whole[key[0]][1] + 0.5)) for key, (a, b) in mass.items()}
        for i, (kind, _, votes, _) in enumerate(patterns):
            odds = math.log(whole[kind][0] / whole[kind][1])
            for name, vote in votes.items():
                a, b = rates[kind, name, vote]
                # A labeler that votes better than chance stays so: a vote for never lowers the odds, one against never raises them.
                ratio = math.log(a / b)
                odds += max(ratio, 0.0) if vote > 0 else min(ratio, 0.0) if vote < 0 else 0.0
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    weights: dict[str, float] = defaultdict(float)
    past: dict[str, float] = defaultdict(lambda: 1e-6)
    total = sum(n for *_, n in patterns)
    named = [features(kind, seen, votes) for kind, seen, votes, _ in patterns]
    for _ in range(STEPS):
        slope: dict[str, float] = defaultdict(float)
        for i, (kind, seen, votes, n) in enumerate(patterns):
            names = named[i]
            z = sum(weights[f] for f in names)
            g = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - belief[i])
            for f in names:
                slope[f] += g
        for f, g in slope.items():
            g += 1e-5 * weights[f]
            past[f] += g * g
            weights[f] -= 0.3 * g / math.sqrt(past[f])
    return Model(rates, dict(weights))


def train(found: DataFrame) -> Model:
    """A model from the candidates in column ``pii``; Spark counts them by votes and features, whose number is bounded by design."""
    seen = [*LABELERS, *FEATURES]
    counted = found.select(F.explode("pii").alias("c")).groupBy("c.kind", *(F.col(f"c.{x}").alias(x) for x in seen)).count().collect()
    return fit(sorted(((r["kind"], tuple(r[x] for x in FEATURES), {x: r[x] for x in LABELERS}, r["count"]) for r in counted), key=str))


def _probability(model: Model, c: Column) -> Column:
    """The classifier as a column expression over a candidate: its weights are looked up in one map."""
    weights = {k: w for k, w in sorted(model.weights.items()) if k != "bias"}
    if not weights:
        return F.lit(0.5)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weight = lambda key: F.coalesce(F.element_at(table, key), F.lit(0.0))
    z = F.lit(model.weights.get("bias", 0.0)) + weight(F.concat(F.lit("kind="), c["kind"]))
    for x in LABELERS:
        z = z + weight(F.concat(F.lit(f"{x}="), c[x].cast("string")))
    for x in (*FEATURES, "strict"):
        z = z + weight(F.concat(c["kind"], F.lit(f":{x}="), c[x].cast("string")))
    return 1 / (1 + F.exp(-z))


def spans(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``spans``: base spans and those that the classifier adds, by start, then kind.

    An added span that overlaps a base span is left out.
    """

    def kept(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind"), c["is_base"].alias("is_base"))

    rows = found.withColumn("base", F.filter("pii", lambda c: c["is_base"]))
    added = F.filter(
        "pii",
        lambda c: ~c["is_base"] & (_probability(model, c) >= 0.5) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return rows.withColumn("spans", F.array_sort(F.transform(F.concat("base", added), kept))).drop("base")


def _listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns for every row; the candidates (not the texts) are written to the shared folder in between."""
    found = written(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("row.id", "pii"), "pii")
    rows = spans(found, train(found))
    base = F.filter("spans", lambda s: s["is_base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["is_base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    return rows.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; overlapping spans become one.

    The model is trained on the same rows.  Null texts stay null; all other columns stay as they are.
    """
    found = written(candidates(docs, text_col), "pii")
    rows = spans(found, train(found))
    text = F.col("text")

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["pos"]
        lead = F.substring(text, state["pos"] + 1, s["start"] - state["pos"])
        more = F.when(fresh, F.concat(state["out"], F.array(F.concat(lead, F.lit("<"), F.upper(s["kind"]), F.lit(">"))))).otherwise(state["out"])
        return F.struct(F.greatest(state["pos"], s["end"]).alias("pos"), more.alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", begin, cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["pos"] + 1, F.length(text))))
    own = lambda c: F.col("row.`" + c.replace("`", "``") + "`")
    redacted = F.when(F.size("spans") > 0, clean).otherwise(own(text_col))
    return rows.select(*[redacted.alias(c) if c == text_col else own(c).alias(c) for c in docs.columns])
