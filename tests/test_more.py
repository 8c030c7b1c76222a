"""Samples, ground rasters, masks, whole repairs and progressive requests."""

import json

import pytest
from pyspark.sql import functions as F

from causeway.functions import stats
from causeway.operators import network, paths, raster, repair
from causeway.sources import networks, samples
from causeway.streaming import progressive


def test_samples(spark, tmp_path):
    line = {"type": "Feature", "properties": {"u": 1, "v": 2}, "geometry": {"type": "LineString", "coordinates": [[77.0, 12.0], [77.1, 12.0]]}}
    (tmp_path / "town.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))
    (tmp_path / "other.txt").write_text("")
    assert [r["name"] for r in samples.available(spark, str(tmp_path)).collect()] == ["town"]
    assert samples.load(spark, str(tmp_path), "town").arcs.count() == 2
    with pytest.raises(FileNotFoundError, match="town"):
        samples.load(spark, str(tmp_path), "city")


def test_ground(spark):
    nodes = spark.createDataFrame([(1, 77.05, 12.95, None, None), (2, 79.0, 12.0, 5.0, None)], "id bigint, x double, y double, elevation double, amenity string")
    dem = spark.createDataFrame([(0, 0, 11.0), (0, 1, 12.0)], "row int, col int, elevation double")
    got = {r["id"]: r["elevation"] for r in samples.with_ground(nodes, dem, 77.0, 13.0, 0.1).collect()}
    assert got == {1: 11.0, 2: 5.0}


def test_from_network_to_mask_and_back(spark):
    nodes = spark.createDataFrame([(0, 77.0, 12.0), (1, 77.01, 12.0), (2, 77.02, 12.0), (3, 77.01, 12.01)], "id bigint, x double, y double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "u bigint, v bigint")
    tile = samples.tile_of(nodes, 80)
    assert tile["width"] in (80, 81) and 0 < tile["height"] < 80
    nothing = spark.createDataFrame([], "tile string, polygon array<struct<x:double,y:double>>")
    mask = samples.imperfect_mask(edges, nodes, tile, nothing, radius=2, dropout=0.0, speckle=0.0)
    found, traced = raster.vectorize(mask, tile["height"], tile["width"], 1.0, 8.0)
    assert found.count() == 4 and traced.count() == 3
    placed = samples.node_places(found, tile).select(F.monotonically_increasing_id().alias("id"), "x", "y")
    assert repair.nearest_match(nodes, placed, 250.0).count() == 4
    noisy = samples.imperfect_mask(edges, nodes, tile, nothing, radius=2, dropout=0.2, speckle=0.01)
    assert noisy.count() != mask.count()


def test_whole_repair(spark):
    at = lambda c, r: (77.62 + 0.002 * c, 12.93 + 0.002 * r)
    places = {0: at(0, 0), 1: at(1, 0), 2: at(2, 0), 3: at(3, 0), 42: at(10, 10), 41: at(10, 9), 43: at(10, 11), 32: at(9, 10), 52: at(11, 10)}
    nodes = spark.createDataFrame([(i, *p) for i, p in places.items()], "id bigint, x double, y double")
    edges = spark.createDataFrame([(0, 1, "primary", None, None), (2, 3, "primary", None, None), *[(42, k, "trunk", k in (41, 43), 1 if k in (41, 43) else 0) for k in (32, 52, 41, 43)]], "u bigint, v bigint, highway string, bridge boolean, layer int")
    quad = [(places[1][0], 12.929), (places[2][0], 12.929), (places[2][0], 12.931), (places[1][0], 12.931)]
    occluders = spark.createDataFrame([(0, "canopy", quad)], "ord int, type string, polygon array<struct<x:double,y:double>>")
    new_edges, new_nodes, log = repair.repair_network(edges, nodes, occluders)
    counts = repair.decision_counts(log).first()
    assert counts["bridged"] == 1 and counts["split"] == 1
    assert {(r["u"], r["v"]) for r in new_edges.collect()} >= {(1, 2), (53, 41), (53, 43)} and new_nodes.count() == 10


def test_agreement_of_equal_networks(spark):
    edges = network.both_ways(spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0)], "u bigint, v bigint, w double"))
    nodes = spark.createDataFrame([(i,) for i in range(4)], "s bigint").withColumn("g", F.lit(0).cast("bigint"))
    d = paths.shortest_paths(edges, nodes)
    other = d.select("g", (F.col("s") + 10).alias("s"), (F.col("v") + 10).alias("v"), "d")
    matches = spark.createDataFrame([(i, i + 10) for i in range(4)], "id bigint, match bigint")
    assert stats.geometric_agreement(d, other, matches).first()["apls"] == 1.0
    lost = d.where("not (s = 0 and v = 3)")
    assert abs(stats.path_agreement(d, lost).first()["apls"] - 5 / 6) < 1e-12


def test_progressive_requests(spark):
    wanted = progressive.request("table:supplier", "length", eps=9.0, delta=0.0, batch=1, most=5)
    assert (wanted["eps"], wanted["delta"], wanted["batch"], wanted["most"]) == (0.5, 0.001, 10, 10)
    assert wanted["key"] != progressive.request("table:supplier", "length", eps=9.0, delta=0.0, batch=1, most=500)["key"]
    edges = network.both_ways(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "u bigint, v bigint, w double"))
    found, progress = progressive.estimate(edges, 4, 3, progressive.request("x", "length", 0.5, 0.5, 10, 20))
    assert progress[-1]["epsilon"] <= 0.5 and found.count() == 3 and progressive.top_edges(found, 1).count() == 1
    nothing, none = progressive.estimate(edges.limit(0), 1, 0, wanted)
    assert nothing.count() == 0 and none == []


def test_open_table_source(spark, data):
    assert networks.open_source(spark, "table:supplier", data).nodes.count() == spark.read.parquet(f"{data}/supplier.parquet").count()
