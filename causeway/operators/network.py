"""Attributes, simple views and zones of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import geo
from causeway.sources.networks import Network

WEIGHTS = ("length", "travel_time_s")
#: Valley floor, height, ripple and its frequency in the synthetic ground (fixed values).
FLOOR, HEIGHT, RIPPLE, WAVE = 6.0, 46.0, 0.05, 6.28
#: Share of the bounding box that a directional zone takes (fixed value).
ZONE_SHARE = 0.22


def annotate(network: Network) -> DataFrame:
    """Arcs with length (the given one, else the great circle between the ends), length_m, travel_time_s and capacity."""
    a = network.nodes.select(F.col("id").alias("u"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    b = network.nodes.select(F.col("id").alias("v"), F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    arcs = network.arcs.join(a, "u").join(b, "v")
    metres = F.coalesce("length", geo.haversine_m(F.col("_y1"), F.col("_x1"), F.col("_y2"), F.col("_x2")))
    arcs = arcs.withColumn("length", metres).drop("_x1", "_y1", "_x2", "_y2")
    return arcs.withColumns({"length_m": F.col("length"), "travel_time_s": geo.travel_time_s(F.col("length"), F.col("highway")), "capacity": geo.capacity_vph(F.col("highway"))})


def collapse(arcs: DataFrame, weight: str, keys: list[str], order: list[str]) -> DataFrame:
    """The row of least weight per key (ties by ``order``); partial minima are taken before the shuffle."""
    rest = [c for c in arcs.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce(weight, F.lit(1.0)), *order))
    return arcs.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def undirected_view(annotated: DataFrame, weight: str = "length") -> DataFrame:
    """One row per unordered pair, u < v, the cheapest of both directions, with its weight as ``w``; no self-loops."""
    if weight not in WEIGHTS:
        raise ValueError(f"unknown weight {weight!r}: use one of {', '.join(WEIGHTS)}")
    pairs = annotated.where("u <> v").withColumns({"_a": F.least("u", "v"), "_b2": F.greatest("u", "v")}).drop("u", "v").withColumnsRenamed({"_a": "u", "_b2": "v"})
    return collapse(pairs, weight, ["u", "v"], ["ord"]).withColumn("w", F.col(weight))


def both_ways(edges: DataFrame) -> DataFrame:
    """``(u, v, w)`` in both directions."""
    return edges.select("u", "v", "w").union(edges.select("v", "u", "w"))


def elevation(nodes: DataFrame) -> DataFrame:
    """Synthetic ground: a valley along the box's diagonal with a ripple.  Nodes keep what they have if all have it."""
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.bool_and(F.col("elevation").isNotNull()).alias("known"))
    placed = nodes.crossJoin(F.broadcast(box))

    def share(v: str, a: str, b: str):
        return (F.col(v) - F.col(a)) / F.coalesce(F.nullif(F.col(b) - F.col(a), F.lit(0.0)), F.lit(1.0))

    s, t = share("x", "x0", "x1"), share("y", "y0", "y1")
    ground = F.round(FLOOR + HEIGHT * (F.abs(s - t) + RIPPLE * F.sin(WAVE * (s + t))), 2)
    return placed.withColumn("elevation", F.when(F.col("known"), F.col("elevation")).otherwise(ground)).drop("x0", "x1", "y0", "y1", "known")


def zone(nodes: DataFrame, spec: str) -> DataFrame:
    """Ids of ``west``, ``east``, ``north``, ``south``, ``ids:1,2`` or ``amenity:x``; ``ValueError`` for other words."""
    if spec.startswith("ids:"):
        wanted = [int(x) for x in spec[4:].split(",") if x.strip()]
        return nodes.where(F.col("id").isin(wanted)).select("id")
    if spec.startswith("amenity:"):
        return nodes.where(F.col("amenity") == spec.split(":", 1)[1]).select("id")
    sides = {"west": ("x", 1), "east": ("x", -1), "south": ("y", 1), "north": ("y", -1)}
    if spec not in sides:
        raise ValueError(f"unknown zone {spec!r}")
    axis, sign = sides[spec]
    box = nodes.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    span = ZONE_SHARE * (F.col("hi") - F.col("lo"))
    inside = F.col(axis) <= F.col("lo") + span if sign > 0 else F.col(axis) >= F.col("hi") - span
    return nodes.crossJoin(F.broadcast(box)).where(inside).select("id")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))
