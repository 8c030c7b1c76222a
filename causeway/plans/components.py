"""Connected components of an edge list, as a fixpoint of DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.plans.durable import discard, repeated, written

#: Shares that the nodes under one label are dealt into when labels are looked up.
SHARES = 32


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label (pointer jumping), so that long chains take a logarithmic number of rounds.  Rounds are written to the
    shared folder.  Self-loops and repeated edges do no harm; rows with a null end are left
    out; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null")
    both = written(pairs.union(pairs.select("dst", "src")).distinct(), "edges")
    labels = written(both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("node"), F.least("src", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("least"))
        lowered = written(labels.join(near.withColumnRenamed("src", "node"), "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was")), "labels")
        # The label's own label; many nodes may share a label, so it is looked up in shares.
        named = lowered.select(F.col("label").alias("node")).distinct()
        further = lowered.select("node", F.col("label").alias("next")).join(named, "node").where("next <> node")
        shares = repeated(further, "share", SHARES).withColumnRenamed("node", "label")
        dealt = lowered.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES)))
        jumped = written(dealt.join(shares, ["label", "share"], "left").select("node", F.coalesce("next", "label").alias("label"), "was"), "labels")
        changed = not jumped.where("label <> was").isEmpty()
        discard(spark, labels)
        discard(spark, lowered)
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
