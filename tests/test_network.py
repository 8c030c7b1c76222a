"""Sources, views, paths, centrality and connectivity against small brute-force versions."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from causeway.functions import geo, stats
from causeway.operators import connectivity, flow, impact, network, paths, scenarios
from causeway.plans.components import connected_components
from causeway.sources import networks
from causeway.streaming import progressive


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "u bigint, v bigint, w double")


def nodes_of(spark, ids, **more):
    return spark.createDataFrame([(i, more.get("x", {}).get(i, float(i)), 0.0, more.get("elevation", {}).get(i), more.get("amenity", {}).get(i)) for i in ids], "id bigint, x double, y double, elevation double, amenity string")


def grid(n):
    rows = []
    for r, c in itertools.product(range(n), repeat=2):
        k = r * n + c
        rows += [(k, k + 1)] if c + 1 < n else []
        rows += [(k, k + n)] if r + 1 < n else []
    return [(a, b, 1 + (i % 4) * 0.5) for i, (a, b) in enumerate(rows)]


def brute_paths(rows, n, directed=False):
    """Distances and numbers of shortest paths, by Floyd and by counting in the order of distance."""
    d = [[0.0 if i == j else math.inf for j in range(n)] for i in range(n)]
    w = {}
    for a, b, x in rows:
        for p, q in ((a, b),) if directed else ((a, b), (b, a)):
            w[p, q] = min(x, w.get((p, q), math.inf))
            d[p][q] = min(d[p][q], x)
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    sigma = [[0.0] * n for _ in range(n)]
    for s in range(n):
        sigma[s][s] = 1.0
        for v in sorted(range(n), key=lambda v: d[s][v]):
            if v != s and d[s][v] < math.inf:
                sigma[s][v] = sum(sigma[s][u] for (u, q), x in w.items() if q == v and abs(d[s][u] + x - d[s][v]) < 1e-9)
    return d, sigma, w


def brute_edge_betweenness(rows, n, directed=False):
    d, sigma, w = brute_paths(rows, n, directed)
    out = {}
    for (u, v), x in w.items():
        total = sum(sigma[s][u] * sigma[v][t] / sigma[s][t] for s in range(n) for t in range(n) if s != t and d[s][t] < math.inf and abs(d[s][u] + x + d[v][t] - d[s][t]) < 1e-9)
        key = (u, v) if directed else (min(u, v), max(u, v))
        out[key] = out.get(key, 0.0) + total / (n * (n - 1))
    return out


def both(edges):
    return network.both_ways(edges)


def test_betweenness_on_a_grid_with_ties(spark):
    rows = grid(4)
    ways = both(edges_of(spark, rows))
    got = {(r["u"], r["v"]): r["betweenness"] for r in paths.edge_betweenness(ways, 16).collect()}
    wanted = brute_edge_betweenness(rows, 16)
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)
    d, sigma, _ = brute_paths(rows, 16)
    node = {r["v"]: r["betweenness"] for r in paths.node_betweenness(ways, 16).collect()}
    for v in range(16):
        want = sum(sigma[s][v] * sigma[v][t] / sigma[s][t] for s in range(16) for t in range(16) if len({s, t, v}) == 3 and abs(d[s][v] + d[v][t] - d[s][t]) < 1e-9) / (15 * 14)
        assert abs(node[v] - want) < 1e-9


def test_directed_betweenness(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 2), (0, 3, 4), (3, 4, 1)]
    got = {(r["u"], r["v"]): r["betweenness"] for r in paths.edge_betweenness(edges_of(spark, rows), 5, directed=True).collect()}
    wanted = brute_edge_betweenness(rows, 5, True)
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def test_sampling_every_source_once_is_exact(spark):
    rows = grid(3)
    ways = both(edges_of(spark, rows))
    draws = spark.createDataFrame([(i % 2, i) for i in range(9)], "batch bigint, s bigint")
    found = paths.sampled_betweenness(ways, draws, 9)
    merged = {(r["u"], r["v"]): r["betweenness"] for r in progressive.merged(found).collect()}
    wanted = brute_edge_betweenness(rows, 9)
    assert all(abs(merged[k] - wanted[k]) < 1e-9 for k in wanted)


def test_stream_of_draws_equals_the_batch_estimate(spark, tmp_path):
    rows = grid(3)
    ways = both(edges_of(spark, rows)).persist()
    source = tmp_path / "draws"
    spark.createDataFrame([(i % 9,) for i in range(18)], "s bigint").coalesce(1).write.parquet(str(source))
    estimator = progressive.Estimator(ways, 9)
    estimator.start(spark.readStream.schema("s bigint").parquet(str(source))).awaitTermination(120)
    wanted = brute_edge_betweenness(rows, 9)
    got = {(r["u"], r["v"]): r["betweenness"] for r in progressive.merged(estimator.estimates()).collect()}
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)
    assert estimator.status(len(rows), 0.9, 0.1)["samples"] == 18


def test_sampling_bounds():
    assert stats.sample_size(74, 0.05, 0.1) == 1460
    assert stats.achieved_epsilon(74, 0.1, 1500) < 0.05 and stats.achieved_epsilon(74, 0.1, 0) == 1.0
    with pytest.raises(ValueError):
        stats.sample_size(10, 0, 0.1)


def test_bridges_and_cut_vertices(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (5, 6, 1), (10, 11, 1)]
    edges = edges_of(spark, rows)
    assert {(r["u"], r["v"]) for r in connectivity.bridges(edges).collect()} == {(2, 3), (5, 6), (10, 11)}
    assert {r["id"] for r in connectivity.articulation_points(edges).collect()} == {2, 3, 5}
    two = {r["id"]: r["component"] for r in connectivity.two_edge_components(edges, nodes_of(spark, [*range(7), 10, 11, 12])).collect()}
    assert two == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 10: 10, 11: 11, 12: 12}


def test_components_of_a_long_chain(spark):
    chain = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(1000, 1000), (2000, 2001), (None, 5)], "a bigint, b bigint"))
    found = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[2001] == 2000 and len(found) == 304
    assert connected_components(chain.limit(0)).count() == 0


def test_removal_impact_and_score(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1)]
    edges, nodes = edges_of(spark, rows), nodes_of(spark, range(6))
    cut = impact.removal_impact(edges, nodes, spark.createDataFrame([(2, 3)], "u bigint, v bigint")).first()
    assert cut["fragmented"] and cut["lcc_after"] == 3 and cut["newly_disconnected_pairs"] == 18
    d, _, _ = brute_paths(rows, 6)
    before = sum(1 / d[i][j] for i in range(6) for j in range(6) if i != j) / 30
    assert abs(cut["efficiency_before"] - before) < 1e-9 and abs(cut["efficiency_after"] - 12 / 30) < 1e-9
    scores = {(r["u"], r["v"]): r for r in impact.analyze(edges, nodes).collect()}
    assert scores[2, 3]["score"] == 100.0 and scores[2, 3]["is_bridge"] and max(r["score"] for k, r in scores.items() if k != (2, 3)) < 100


def test_current_flow_of_a_bridge(spark):
    rows = [(0, 1, 2), (1, 2, 3), (2, 0, 1), (2, 3, 5), (8, 9, 1)]
    got = {(r["u"], r["v"]): r["current_flow"] for r in impact.current_flow(edges_of(spark, rows)).collect()}
    assert abs(got[2, 3] - 3 * 1 / (3 * 2)) < 1e-9 and got[8, 9] == 0


def test_flow_network(spark):
    rows = [(0, 1, 16), (0, 2, 13), (1, 2, 10), (2, 1, 4), (1, 3, 12), (3, 2, 9), (2, 4, 14), (4, 3, 7), (3, 5, 20), (4, 5, 4)]
    edges = edges_of(spark, rows).withColumnRenamed("w", "capacity")
    zones = spark.createDataFrame([("a", 0, "source"), ("a", 5, "sink"), ("b", 0, "source"), ("b", 99, "sink")], "od string, id bigint, role string")
    found = flow.min_cuts(edges, zones, directed=True).collect()
    assert {r["max_flow"] for r in found if r["od"] == "a"} == {23.0}
    assert sum(r["capacity"] for r in found if r["od"] == "a") == 23.0
    assert [(r["max_flow"], r["u"]) for r in found if r["od"] == "b"] == [(0.0, None)]


def test_floods_and_restoration(spark):
    edges = edges_of(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (0, 5, 1)])
    nodes = nodes_of(spark, range(6), elevation={0: 20.0, 1: 12.0, 2: 30.0, 3: 30.0, 4: 30.0, 5: 9.0}, amenity={0: "hospital"})
    sweep = {r["level"]: r for r in scenarios.flood_impact(edges, nodes, [0.0, 10.0, 15.0]).collect()}
    assert [sweep[x]["submerged_count"] for x in (0.0, 10.0, 15.0)] == [0, 1, 3]
    assert [sweep[x]["lost_access_count"] for x in (0.0, 10.0, 15.0)] == [0, 1, 5]
    picks = scenarios.restoration_priority(edges, nodes, 15.0).collect()
    assert [(p["u"], p["v"], p["restores"]) for p in picks] == [(0, 1, 1), (1, 2, 3), (0, 5, 1)]
    assert {r["id"] for r in scenarios.lost_access(edges, nodes, 10.0).collect()} == {5}
    untagged = nodes.withColumn("amenity", F.lit(None).cast("string"))
    assert {r["id"] for r in scenarios.hospitals(untagged).collect()} == {2, 3}


def test_attack_curves(spark):
    edges, nodes = edges_of(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 0, 1), (0, 2, 1)]), nodes_of(spark, range(5))
    random = scenarios.random_attack(edges, nodes, 3).orderBy("step").collect()
    assert [r["fraction"] for r in random] == pytest.approx([0, 1 / 3, 2 / 3, 1]) and random[0]["lcc"] == 1 and random[-1]["lcc"] == 0.2
    targeted = scenarios.targeted_attack(edges, nodes, 3).orderBy("step").collect()
    assert len(targeted) == 4 and targeted[-1]["lcc"] == 0.2
    area = stats.area_under(scenarios.random_attack(edges, nodes, 3).withColumn("k", F.lit("r")), "fraction", "lcc", ["k"]).first()["auc"]
    wanted = sum((b["fraction"] - a["fraction"]) * (a["lcc"] + b["lcc"]) / 2 for a, b in itertools.pairwise(random))
    assert abs(area - wanted) < 1e-12


def test_ranks_and_correlations(spark):
    rows = spark.createDataFrame([(1.0, 10.0), (2.0, 10.0), (2.0, 30.0), (5.0, 40.0)], "a double, b double")
    ranks = sorted(r["r"] for r in stats.average_ranks(rows, "a", "r").collect())
    assert ranks == [1.0, 2.5, 2.5, 4.0]
    assert abs(stats.spearman(rows, "a", "b").first()["r"] - 0.8333333) < 1e-6
    assert stats.pearson(rows.withColumn("b", F.lit(1.0)), "a", "b").first()["r"] == 0.0
    assert stats.pearson(rows.limit(0), "a", "b").first()["r"] == 0.0


def test_geojson_round_trip(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"u": 1, "v": 2, "highway": "primary", "oneway": False}, "geometry": {"type": "LineString", "coordinates": [[77.62, 12.93], [77.624, 12.93]]}},
        {"type": "Feature", "properties": {"u": 2, "v": 3, "oneway": True, "length": 7.0}, "geometry": {"type": "LineString", "coordinates": [[77.624, 12.93], [77.7, 12.9], [77.624, 12.934]]}},
    ]
    path = tmp_path / "sample.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    net = networks.open_source(spark, f"geojson:{path}")
    arcs = {(r["u"], r["v"]): r for r in network.annotate(net).collect()}
    assert arcs.keys() == {(1, 2), (2, 1), (2, 3)} and arcs[2, 3]["length"] == 7.0 and arcs[2, 3]["capacity"] == 400.0
    assert abs(arcs[1, 2]["length_m"] - 433.5) < 1 and arcs[1, 2]["capacity"] == 1200.0
    edges = network.undirected_view(network.annotate(net))
    line = json.loads(networks.edge_features(edges, net.nodes, ["highway"]).where("u = 1").first()["feature"])
    assert line["geometry"]["coordinates"] == [[77.62, 12.93], [77.624, 12.93]] and line["properties"]["highway"] == "primary"
    networks.write_features(networks.node_features(net.nodes, []), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    for bad in ("file:x", "table:nothing"):
        with pytest.raises(ValueError):
            networks.open_source(spark, bad, "x")
    with pytest.raises(ValueError):
        network.undirected_view(network.annotate(net), "colour")
    with pytest.raises(ValueError):
        network.zone(net.nodes, "middle")


def test_formulas(spark):
    row = spark.range(1).select(
        geo.bpr_time(F.lit(10.0), F.lit(2.0), F.lit(1.0)).alias("loaded"), geo.bpr_time(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("none"), geo.conductance(F.lit(0.0)).alias("unit"),
        geo.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("flat"), geo.speed_kmh(F.lit(None).cast("string")).alias("speed"),
    ).first()
    assert row["loaded"] == pytest.approx(10 * (1 + 0.15 * 16)) and row["none"] == math.inf and (row["unit"], row["flat"], row["speed"]) == (1.0, 0.0, 28.0)
