"""Trees in logarithmic rounds: spanning forests by hooking, Euler tours ranked by pointers, totals below and above every node.

Nothing here follows a tree level by level.  Pointers are followed :data:`REACH` - 1 times a written round, each time in a
table whose pointers are that many times as long as those of the round before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.plans.durable import discard, repeated, written

#: How many times longer pointers get in a round, and shares that rows with the same key are dealt into.
REACH, SHARES = 8, 8

#: Shares that the neighbours of a node are ordered in.
TURNS = 32

#: Where a root starts: before all places.
BEFORE = -(1 << 62)


def share_of(*columns: str, shares: int = SHARES) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shares)).cast("int")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` with what ``table`` (a row a key) has for their keys; rows of one key are dealt into shares by columns ``by``."""
    shares = repeated(table, "_share", SHARES)
    return rows.withColumn("_share", share_of(*by)).join(shares, [*keys, "_share"], "left").drop("_share")


def _joined(a: Column, b: Column, fold) -> Column:
    return F.when(b.isNull(), a).otherwise(fold(a, b))


def along(state: DataFrame, values: dict, shared: bool) -> DataFrame:
    """Values of rows (node, up, values) folded with those of all rows that lie on the way up; ``up`` ends null.

    ``values`` names columns and how two of them are folded (both orders the same).  ``shared``: many rows may point to the same one.
    The given state is read several times, so it should be a written table or little more.
    """
    spark, given = state.sparkSession, True
    while given or not state.where("up is not null").isEmpty():
        table = state.select(F.col("node").alias("_at"), F.col("up").alias("_next"), *(F.col(c).alias(f"_{c}") for c in values))
        rows = state
        for _ in range(REACH - 1):
            keyed = rows.withColumnRenamed("up", "_at")
            found = looked_up(keyed, table, ["_at"], ["node"]) if shared else keyed.join(table, "_at", "left")
            rows = found.select("node", F.col("_next").alias("up"), *(_joined(F.col(c), F.col(f"_{c}"), f).alias(c) for c, f in values.items()))
        after = written(rows, "pointers")
        if not given:
            discard(spark, state)
        state, given = after, False
    return state.drop("up")


def below(tree: DataFrame, start: DataFrame, totals: dict) -> DataFrame:
    """Totals (a column's name and its aggregate function) of ``start`` (node, columns) over each node and all nodes below it.

    ``tree`` is (node, up), with null above roots.  A round adds what lies 1 to REACH - 1 pointers below, each row once.  Nodes without rows in ``start`` have nulls to begin with.
    """
    spark, state = tree.sparkSession, written(tree.join(start, "node", "left"), "totals")
    while not state.where("up is not null").isEmpty():
        table = state.select(F.col("node").alias("_at"), F.col("up").alias("_next"))
        rows, given = state.withColumnRenamed("up", "_at"), state.select("node", *totals)
        for _ in range(REACH - 1):
            given = given.unionByName(rows.where("_at is not null").select(F.col("_at").alias("node"), *totals))
            rows = looked_up(rows.where("_at is not null"), table, ["_at"], ["node"]).select("node", F.col("_next").alias("_at"), *totals)
        sums = given.groupBy("node").agg(*(f(c).alias(c) for c, f in totals.items()))
        # Only rows whose pointers have not ended are left in ``rows``.
        after = written(sums.join(rows.select("node", F.col("_at").alias("up")), "node", "left"), "totals")
        discard(spark, state)
        state = after
    return state.drop("up")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The forest's edges (u, v) and each tree's root (node), from distinct edges with u < v.

    In every round each part takes its least edge to another part, in the order of a hash, and parts so tied become one.  Edges between
    the same two parts are reduced to the least one.  Parts fall to less than half a round.
    """
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    order = F.struct(F.xxhash64("u", "v", F.lit("forest")).alias("h"), "u", "v")
    live = written(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), order.alias("e")), "live")
    forest, ended = [], []
    while not live.isEmpty():
        ways = live.union(live.select("b", "a", "e"))
        picks = written(ways.groupBy("a").agg(F.min(F.struct("e", "b")).alias("p")).select("a", F.col("p.b").alias("b"), "p.e"), "picks")
        # Orders are total, so parts pick in a circle only where two pick the same edge: the smaller one stays.
        kept = picks.groupBy("e").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 2").select("a", F.lit(True).alias("root"))
        forest.append(picks.select("e.u", "e.v").distinct())
        state = picks.join(kept, "a", "left").select(F.col("a").alias("node"), F.when(F.col("root"), F.lit(None)).otherwise(F.col("b")).alias("up"), F.when(F.col("root"), F.col("a")).alias("top"))
        tops = along(state, {"top": lambda x, y: F.coalesce(x, y)}, shared=True)
        ended.append(tops.where("node <> top").select("node"))
        name = lambda end: tops.select(F.col("node").alias(end), F.col("top").alias(f"{end}_top"))
        moved = looked_up(looked_up(live, name("a"), ["a"], ["e"]), name("b"), ["b"], ["e"]).select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b"), "e")
        after = written(moved.where("a <> b").groupBy("a", "b").agg(F.min("e").alias("e")), "live")
        discard(spark, live)
        live = after
    none = edges.select("u", "v").limit(0)
    every, gone = none, none.select(F.col("u").alias("node"))
    for part, lost in zip(forest, ended, strict=True):
        every, gone = every.unionByName(part), gone.unionByName(lost)
    return written(every, "forest"), written(nodes.join(gone, "node", "left_anti"), "roots")


def beside(rows: DataFrame, group: list[str], share: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the values next to theirs in the group's order (share, order), null at its ends, and the group's ``first``.

    Shares are ordered one by one, and then the shares of a group, so no task orders a whole group.
    """
    w = Window.partitionBy(*group, share).orderBy(order)
    near = rows.withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w))
    ends = rows.groupBy(*group, share).agg(F.min_by(value, order).alias("_low"), F.max_by(value, order).alias("_high"))
    g = Window.partitionBy(*group).orderBy(share)
    linked = ends.select(*group, share, F.lag("_high").over(g).alias("_left"), F.lead("_low").over(g).alias("_right"), F.first("_low").over(g).alias("first"))
    return near.join(linked, [*group, share]).select(*rows.columns, F.coalesce("_before", "_left").alias("before"), F.coalesce("_after", "_right").alias("after"), "first")


def rooted(edges: DataFrame) -> DataFrame:
    """``(node, up, start, end)``: a rooted spanning forest of distinct edges with u < v, with places on each tree's Euler tour.

    A tour goes along every tree edge down and up; after an arc comes the arc to the next neighbour.  Arcs are ranked by their distance from the tour's end.
    A node w is below v, or v itself, if v's start <= w's start <= v's end (within a tree).  Roots start at :data:`BEFORE` and end at 0.
    """
    forest, roots = spanning_forest(edges)
    arcs = forest.union(forest.select("v", "u")).withColumn("turn", share_of("u", shares=TURNS))
    # Seen from v: where the tour goes on after coming from u.  At a root the last arc back ends it.
    turned = beside(arcs, ["v"], "turn", "u", "u")
    marked = turned.join(roots.select(F.col("node").alias("v"), F.lit(True).alias("root")), "v", "left")
    onward = F.coalesce("after", F.when(F.col("root").isNull(), F.col("first")))
    pointers = marked.select(F.struct("u", "v").alias("node"), F.when(onward.isNotNull(), F.struct(F.col("v").alias("u"), onward.alias("v"))).alias("up"), F.lit(1).cast("bigint").alias("d"))
    places = written(along(written(pointers, "arcs"), {"d": lambda x, y: x + y}, shared=False).select("node.u", "node.v", (-F.col("d")).alias("at")), "places")
    back = places.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("at").alias("end"))
    nodes = places.join(back, ["u", "v"]).where("at < end").select(F.col("v").alias("node"), F.col("u").alias("up"), F.col("at").alias("start"), "end")
    tops = roots.select("node", F.lit(None).cast("bigint").alias("up"), F.lit(BEFORE).alias("start"), F.lit(0).cast("bigint").alias("end"))
    return written(nodes.unionByName(tops), "rooted")
