"""Tables whose size Spark misjudges are not sent whole to the driver and every executor."""

from pyspark.sql import functions as F

from causeway.llm import common, simhash
from causeway.plans import components, durable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def expected_bytes(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_filed_keys_are_not_broadcast(spark):
    filed = spark.range(1000).select(F.pmod("id", F.lit(300)).alias("key"), F.col("id").alias("print"))
    shared = simhash._shared(filed, "print")
    assert "BroadcastHashJoin" not in plan(shared)
    assert {tuple(r) for r in shared.where("key = 7").collect()} == {(7, p, 7, 907) for p in (7, 307, 607, 907)}


def test_a_repeated_table_is_expected_to_be_larger(spark):
    small = durable.written(spark.range(50_000).select(F.col("id").alias("key"), F.lit("x").alias("name")), "small")
    assert expected_bytes(durable.repeated(small, "n", 32)) >= 32 * expected_bytes(small)
    looked = common.salted_lookup(spark.range(2_000_000).select(F.col("id").alias("key")), small, ["key"], F.col("key"))
    assert "BroadcastHashJoin" not in plan(looked)
    assert durable.repeated(small, "n", 3).where("key = 9").count() == 3


def test_labels_that_repeat_are_not_taken_for_small(spark):
    one = durable.written(spark.range(1_500_000).select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("label")), "labels")
    # Rows of two numbers take 24 bytes in memory, whatever the file takes.
    assert expected_bytes(one) >= 24 * 1_500_000


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1030)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(200)} | {i: 1000 for i in range(1000, 1031)}


def test_labels_of_scenarios_are_not_broadcast(spark):
    node = lambda x: F.struct(F.lit(1).cast("bigint").alias("g"), x.alias("id"))
    one = spark.range(400_000).select(node(F.col("id")).alias("dst"), node(F.lit(0).cast("bigint")).alias("label"))
    labels = durable.written(one.repartition(4), "labels")
    edges = durable.written(labels.select(F.col("dst").alias("src"), "dst"), "edges")
    assert expected_bytes(labels) > 10 << 20 and "BroadcastHashJoin" not in plan(edges.join(labels, "dst"))


def test_labels_of_one_component_are_not_broadcast(spark):
    labels = durable.written(spark.range(900_000).select(F.col("id").alias("dst"), F.lit(0).cast("bigint").alias("label")).repartition(4), "labels")
    edges = durable.written(labels.select(F.col("dst").alias("src"), "dst"), "edges")
    assert "BroadcastHashJoin" not in plan(edges.join(labels, "dst"))
