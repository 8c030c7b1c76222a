"""Networks from tables and GeoJSON files, and GeoJSON out.

A network is two relations: ``nodes(id, x, y, elevation, amenity)`` and ``arcs(ord, u, v, highway, name, oneway, length)``,
one row a direction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Classes that derived roads get by nation.
CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street", "service", "unclassified")
#: Origin and pitch of the derived grid in degrees.
LON0, LAT0, LON_STEP, LAT_STEP, JITTER = 77.62, 12.93, 0.004, 0.0034, 9e-6
KEYS = {"supplier": ("s_suppkey", "s_acctbal", "s_nationkey"), "customer": ("c_custkey", "c_acctbal", "c_nationkey")}


@dataclass
class Network:
    nodes: DataFrame
    arcs: DataFrame


def from_table(spark: SparkSession, sf_dir: str, name: str = "supplier") -> Network:
    """A road grid that follows from a table's keys, balances and nations.

    Keys 0..n-1 lie row by row in a grid as wide as it is high; balances jitter the places and drop streets.
    """
    key, balance, nation = KEYS[name]
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(
        F.col(key).cast("bigint").alias("id"), F.abs(F.round(F.col(balance) * 100).cast("bigint")).alias("c"), F.col(nation).alias("nation")
    )
    size = rows.agg(F.count("*").alias("n")).select("n", F.floor(F.sqrt("n")).cast("bigint").alias("w"))
    grid = rows.crossJoin(F.broadcast(size)).withColumns({"col": F.col("id") % F.col("w"), "row": F.floor(F.col("id") / F.col("w"))})
    jitter = (F.col("c") % 100 - 50) * F.lit(JITTER)
    nodes = grid.select(
        "id",
        (F.lit(LON0) + F.lit(LON_STEP) * F.col("col") + jitter).alias("x"),
        (F.lit(LAT0) + F.lit(LAT_STEP) * F.col("row") + jitter).alias("y"),
        F.lit(None).cast("double").alias("elevation"),
        F.when(F.col("nation") % 8 == 0, "hospital").alias("amenity"),
    )
    across = (F.col("col") < F.col("w") - 1) & (F.col("id") + 1 < F.col("n")) & (F.col("c") % 5 != 0)
    along = (F.col("id") + F.col("w") < F.col("n")) & (F.floor(F.col("c") / 5) % 5 != 0)
    ways = F.array_compact(F.array(F.when(across, F.col("id") + 1), F.when(along, F.col("id") + F.col("w"))))
    highway = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("nation") % 9 + 1).cast("int"))
    streets = grid.select("id", "c", "nation", F.posexplode(ways).alias("pos", "v")).select(
        (F.col("id") * 2 + F.col("pos")).alias("ord"), F.col("id").alias("u"), "v", highway.alias("highway"), F.lit(None).cast("string").alias("name"), (F.col("c") % 11 == 0).alias("oneway")
    )
    return Network(nodes, with_reverse(streets.withColumn("length", F.lit(None).cast("double"))))


def with_reverse(streets: DataFrame) -> DataFrame:
    """Both directions of every street that isn't one-way, in one pass."""
    ways = F.when(F.coalesce("oneway", F.lit(False)), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    rest = [c for c in streets.columns if c not in ("u", "v")]
    return streets.select(*rest, F.explode(ways).alias("_w")).select("_w.u", "_w.v", *rest)


_POINTS = ArrayType(ArrayType(DoubleType()))
GEOJSON = StructType([
    StructField("type", StringType()),
    StructField("features", ArrayType(StructType([
        StructField("type", StringType()),
        StructField("properties", StructType([StructField("u", LongType()), StructField("v", LongType()), StructField("highway", StringType()), StructField("oneway", BooleanType()), StructField("name", StringType()), StructField("length", DoubleType())])),
        StructField("geometry", StructType([StructField("type", StringType()), StructField("coordinates", _POINTS)])),
    ]))),
])


def from_geojson(spark: SparkSession, path: str) -> Network:
    """Streets of a feature collection: ends from the first and last coordinates, a reverse arc unless one-way."""
    features = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    p, line = F.col("f.properties"), F.col("f.geometry.coordinates")
    streets = features.select(F.col("ord").cast("bigint").alias("ord"), p["u"].alias("u"), p["v"].alias("v"), p["highway"].alias("highway"), p["name"].alias("name"), F.coalesce(p["oneway"], F.lit(False)).alias("oneway"), p["length"].alias("length"), F.element_at(line, 1).alias("a"), F.element_at(line, -1).alias("b"))
    ends = streets.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("a").alias("p"), (F.col("ord") * 2).alias("o")), F.struct(F.col("v").alias("id"), F.col("b").alias("p"), (F.col("ord") * 2 + 1).alias("o")))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.max_by("e.p", "e.o").alias("p")).select("id", F.element_at("p", 1).alias("x"), F.element_at("p", 2).alias("y"), F.lit(None).cast("double").alias("elevation"), F.lit(None).cast("string").alias("amenity"))
    return Network(nodes, with_reverse(streets.drop("a", "b")))


def open_source(spark: SparkSession, source: str, sf_dir: str | None = None) -> Network:
    """``table:supplier`` or ``geojson:/path``; raises ``ValueError`` for anything else."""
    kind, _, what = source.partition(":")
    if kind == "table" and what in KEYS and sf_dir:
        return from_table(spark, sf_dir, what)
    if kind == "geojson" and what:
        return from_geojson(spark, what)
    raise ValueError(f"unknown source {source!r}: use table:supplier, table:customer or geojson:<path>")


def edge_features(edges: DataFrame, nodes: DataFrame, properties: list[str]) -> DataFrame:
    """``(u, v, feature)``: a GeoJSON LineString per edge with the named columns as properties."""
    a = nodes.select(F.col("id").alias("u"), F.array("x", "y").alias("a"))
    b = nodes.select(F.col("id").alias("v"), F.array("x", "y").alias("b"))
    placed = edges.join(a, "u").join(b, "v")
    shape = F.struct(F.lit("LineString").alias("type"), F.array("a", "b").alias("coordinates"))
    return placed.select("u", "v", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("u", "v", *properties).alias("properties"))).alias("feature"))


def node_features(nodes: DataFrame, properties: list[str]) -> DataFrame:
    """``(id, feature)``: a GeoJSON Point per node."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return nodes.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("id", *properties).alias("properties"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line (newline-delimited GeoJSON), which writes and reads in parallel."""
    features.select(F.col("feature").alias("value")).write.text(path)

