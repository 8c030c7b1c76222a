"""Repair and raster operators on drawn examples."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import raster, repair

LON, LAT = 0.004, 0.0034


def place(i):
    return 77.62 + LON * (i // 10), 12.93 + LAT * (i % 10)


@pytest.fixture(scope="module")
def broken(spark):
    """Two straight roads, each with a gap; an occluder lies over the first gap only.  A flyover crosses a road at 42."""
    pairs = [(0, 10), (10, 20), (40, 50), (50, 60), (5, 15), (15, 25), (45, 55)]
    cross = [(42, 32), (42, 52), (42, 41), (42, 43)]
    edges = spark.createDataFrame([(u, v, "primary", u == 42 and v in (41, 43), 0) for u, v in pairs + cross], "u bigint, v bigint, highway string, bridge boolean, layer int")
    ids = sorted({i for p in pairs + cross for i in p})
    # The ends of a gap lie within reach: the far parts are moved towards the near ones.
    shift = {i: -0.0055 for i in (40, 50, 60, 45, 55)}
    nodes = spark.createDataFrame([(i, place(i)[0] + shift.get(i, 0.0), place(i)[1]) for i in ids], "id bigint, x double, y double")
    mid = (place(20)[0] + place(40)[0] + shift[40]) / 2
    quad = [(mid - 0.001, 12.929), (mid + 0.001, 12.929), (mid + 0.001, 12.931), (mid - 0.001, 12.931)]
    occluders = spark.createDataFrame([(0, "canopy", quad)], "ord int, type string, polygon array<struct<x:double,y:double>>")
    return edges, nodes, occluders


def test_gaps(spark, broken):
    edges, nodes, occluders = broken
    log = {(r["a"], r["b"]): r for r in repair.close_gaps(repair.gap_candidates(edges, nodes, occluders)).collect()}
    assert log[20, 40]["decision"] == "bridged" and log[20, 40]["occluder"] == "canopy" and log[20, 40]["straightness"] > 0.99
    assert log[25, 45]["decision"] == "rejected"
    added = repair.bridged_edges(repair.close_gaps(repair.gap_candidates(edges, nodes, occluders))).collect()
    assert [(r["u"], r["v"], r["highway"]) for r in added] == [(20, 40, "primary")]
    labels = spark.createDataFrame([(20, 40, True), (25, 45, False)], "a bigint, b bigint, real boolean")
    quality = repair.gap_quality(repair.close_gaps(repair.gap_candidates(edges, nodes, occluders)), labels).first()
    assert (quality["precision"], quality["recall"], quality["decoys_bridged"]) == (1.0, 1.0, 0)


def test_greedy_matching_equals_one_by_one(spark):
    rows = [(1, 2, 10.0, 0.99), (2, 3, 20.0, 0.98), (3, 4, 5.0, 0.97), (4, 5, 9.0, 0.5), (5, 6, 9.0, 0.96), (1, 7, 3.0, 0.95), (8, 9, 1.0, 0.1)]
    frame = spark.createDataFrame([(a, b, g, s, "canopy", "x") for a, b, g, s in rows], "a bigint, b bigint, gap_m double, straightness double, occluder string, highway string")
    spent, wanted = set(), {}
    for a, b, g, s in sorted(rows, key=lambda r: (-r[3], r[2], r[0], r[1])):
        if a in spent or b in spent:
            continue
        wanted[a, b] = "bridged" if s >= repair.STRAIGHT else "rejected"
        if wanted[a, b] == "bridged":
            spent |= {a, b}
    assert {(r["a"], r["b"]): r["decision"] for r in repair.close_gaps(frame).collect()} == wanted


def test_flyover(spark, broken):
    edges, nodes, _ = broken
    straight = nodes.where("id in (32, 52, 41, 43, 42)")
    own = edges.where("u = 42")
    log = repair.crossings(own, straight)
    row = log.first()
    assert row["id"] == 42 and row["decision"] == "split" and sorted(row["over"]) == [41, 43] and sorted(row["under"]) == [32, 52]
    new_edges, new_nodes = repair.split_flyovers(own, straight, log)
    assert {(r["u"], r["v"]) for r in new_edges.collect()} == {(42, 32), (42, 52), (53, 41), (53, 43)}
    assert new_nodes.where("id = 53").count() == 1
    kept = repair.crossings(own.withColumn("bridge", F.lit(False)), straight).first()
    assert kept["decision"] == "kept"


def test_nearest_match(spark):
    truth = spark.createDataFrame([(1, 77.0, 12.0), (2, 77.1, 12.0)], "id bigint, x double, y double")
    found = spark.createDataFrame([(7, 77.0001, 12.0), (8, 77.0002, 12.0), (9, 78.0, 12.0)], "id bigint, x double, y double")
    rows = repair.nearest_match(truth, found).collect()
    assert [(r["id"], r["match"]) for r in rows] == [(1, 7)]


def pixels(spark, art):
    return spark.createDataFrame([("t", r, c) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"], "tile string, row int, col int")


def test_dilate_and_erode(spark):
    dot = pixels(spark, ["...", ".#.", "..."])
    grown = raster.dilate(dot, 1, 3, 3)
    assert {(r["row"], r["col"]) for r in grown.collect()} == {(1, 1), (0, 1), (2, 1), (1, 0), (1, 2)}
    assert {(r["row"], r["col"]) for r in raster.erode(grown, 1).collect()} == {(1, 1)}
    assert raster.dilate(pixels(spark, ["#"]), 2, 1, 1).count() == 1


def test_rasterize_diagonal(spark):
    line = spark.createDataFrame([("t", 0, 0, 5, 10)], "tile string, r0 int, c0 int, r1 int, c1 int")
    rows = sorted((r["row"], r["col"]) for r in raster.rasterize(line, 20, 20, 0).collect())
    assert len(rows) == 11 and rows[0] == (0, 0) and rows[-1] == (5, 10)


def test_t_junction(spark):
    roads = spark.createDataFrame([("t", 30, 5, 30, 55), ("t", 30, 30, 55, 30)], "tile string, r0 int, c0 int, r1 int, c1 int")
    mask = raster.rasterize(roads, 60, 60, 3)
    nodes, edges = raster.vectorize(mask, 60, 60, 1.0, 8.0)
    assert nodes.count() == 4 and edges.count() == 3
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().collect()
    assert sorted(r["count"] for r in ends) == [1, 1, 1, 3]


def test_occluded_pixels(spark):
    row = pixels(spark, ["##########"])
    quad = [(2.5, -1.0), (5.5, -1.0), (5.5, 1.0), (2.5, 1.0)]
    occluders = spark.createDataFrame([("t", quad)], "tile string, polygon array<struct<x:double,y:double>>")
    assert sorted(r["col"] for r in raster.covered(row, occluders).collect()) == [0, 1, 2, 6, 7, 8, 9]
