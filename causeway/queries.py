"""Registered queries over the networks that tables imply, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import geo, stats
from causeway.operators import connectivity, flow, impact, network, paths, raster, repair, reports, scenarios
from causeway.plans.durable import written
from causeway.sources import networks
from causeway.streaming import progressive

LEVEL = 14.0
SWEEP = [10.0, 12.0, 14.0, 18.0]
BATCH_DRAWS = 1000


def _network(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated arcs, undirected edges and nodes with elevation."""
    net = networks.from_table(spark, sf_dir, name)
    arcs = network.annotate(net)
    return arcs, network.undirected_view(arcs), network.elevation(net.nodes)


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """The supplier network's edges in both directions (written once), its nodes and their number."""
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    return written(network.both_ways(edges), "ways"), nodes, nodes.count()


def _sources(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.lit(0).cast("bigint").alias("g"), F.col("id").alias("s"))


def annotate_edges(spark, sf_dir):
    arcs, _, _ = _network(spark, sf_dir, "customer")
    return arcs.select("u", "v", "highway", F.round("length_m", 4).alias("length_m"), F.round("travel_time_s", 4).alias("travel_time_s"), "capacity")


def undirected_view(spark, sf_dir):
    _, edges, _ = _network(spark, sf_dir, "customer")
    return edges.select("u", "v", "highway", F.round("w", 4).alias("w"))


def collapse_parallel(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return network.collapse(lines, "l_extendedprice", ["u", "v"], ["l_orderkey", "l_linenumber"])


def bipartite_degree(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("degree"), F.count_distinct("l_partkey").alias("neighbours"))


def zones(spark, sf_dir):
    _, _, nodes = _network(spark, sf_dir, "customer")
    out = None
    for spec in ("west", "east", "north", "south", "amenity:hospital", "ids:1,2,3,999999"):
        part = network.zone(nodes, spec).select(F.lit(spec).alias("zone"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def elevation(spark, sf_dir):
    _, _, nodes = _network(spark, sf_dir, "customer")
    return nodes.select("id", "elevation")


def degree(spark, sf_dir):
    _, edges, _ = _network(spark, sf_dir, "customer")
    return network.degrees(edges)


def submerged_edges(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    return scenarios.submerged(edges, nodes, LEVEL).select("u", "v")


def components(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    return connectivity.components(edges, nodes)


def component_summary(spark, sf_dir):
    return connectivity.summary(components(spark, sf_dir))


def bridges(spark, sf_dir):
    _, edges, _ = _network(spark, sf_dir, "supplier")
    return connectivity.bridges(edges)


def articulation_points(spark, sf_dir):
    _, edges, _ = _network(spark, sf_dir, "supplier")
    return connectivity.articulation_points(edges)


def two_edge_components(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    return connectivity.two_edge_components(edges, nodes)


def three_edge_components(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    return connectivity.three_edge_components(edges, nodes)


def apsp(spark, sf_dir):
    ways, nodes, _ = _paths(spark, sf_dir)
    return paths.shortest_paths(ways, _sources(nodes)).select("s", "v", F.round("d", 4).alias("d"))


def sssp_hops(spark, sf_dir):
    ways, nodes, _ = _paths(spark, sf_dir)
    return paths.shortest_paths(paths.hop_edges(ways), _sources(nodes)).select("s", "v", F.col("d").cast("bigint").alias("hops"))


def sigma_counts(spark, sf_dir):
    ways, nodes, _ = _paths(spark, sf_dir)
    hops = paths.with_graph(paths.hop_edges(ways))
    distances = paths.shortest_paths(hops, _sources(nodes))
    return paths.path_counts(distances, paths.tight_edges(distances, hops)).select("s", "v", F.col("sigma").cast("bigint").alias("sigma"))


def global_efficiency(spark, sf_dir):
    ways, nodes, n = _paths(spark, sf_dir)
    return paths.global_efficiency(paths.shortest_paths(ways, _sources(nodes)), n).select(F.round("efficiency", 9).alias("efficiency"))


def edge_betweenness(spark, sf_dir):
    ways, _, n = _paths(spark, sf_dir)
    return paths.edge_betweenness(ways, n).select("u", "v", F.round("betweenness", 8).alias("betweenness"))


def edge_betweenness_directed(spark, sf_dir):
    arcs, _, nodes = _network(spark, sf_dir, "supplier")
    ways = written(arcs.select("u", "v", F.col("length").alias("w")), "arcs")
    return paths.edge_betweenness(ways, nodes.count(), directed=True).select("u", "v", F.round("betweenness", 8).alias("betweenness"))


def node_betweenness(spark, sf_dir):
    ways, _, n = _paths(spark, sf_dir)
    return paths.node_betweenness(ways, n).select(F.col("v").alias("id"), F.round("betweenness", 8).alias("betweenness"))


def _draws(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Sources drawn by users of events, in batches of 1,000 events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.floor(F.col("event_id") / BATCH_DRAWS).alias("batch"), (F.col("user_id") % n).alias("s"))


def sampled_betweenness(spark, sf_dir):
    ways, _, n = _paths(spark, sf_dir)
    found = paths.sampled_betweenness(ways, _draws(spark, sf_dir, n), n)
    return progressive.merged(found).select("u", "v", F.round("betweenness", 8).alias("betweenness"))


def streamed_betweenness(spark, sf_dir):
    """The same estimate from a stream of events, folded micro-batch by micro-batch."""
    ways, _, n = _paths(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A stream takes a folder or a pattern; the pattern stands for the table whether it is a file or a folder.
    draws = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select((F.col("user_id") % n).alias("s"))
    estimator = progressive.Estimator(ways, n)
    estimator.start(draws).awaitTermination()
    return progressive.merged(estimator.estimates()).select("u", "v", F.round("betweenness", 8).alias("betweenness"))


def progressive_epsilon(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    draws = _draws(spark, sf_dir, nodes.count()).groupBy("batch").agg(F.count("*").alias("samples"))
    return progressive.certified(draws, edges.count(), 0.1).select("batch", "samples", F.round("epsilon", 6).alias("epsilon"))


def current_flow(spark, sf_dir):
    _, edges, _ = _network(spark, sf_dir, "supplier")
    return impact.current_flow(edges).select("u", "v", F.round("current_flow", 8).alias("current_flow"))


def removal_impact(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    edges = written(edges, "edges")
    found = impact.removal_impact(edges, nodes, edges)
    return found.select("u", "v", F.round("relative_drop", 6).alias("relative_drop"), "lcc_before", "lcc_after", "fragmented", "newly_disconnected_pairs")


def resilience_score(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    return impact.analyze(written(edges, "edges"), written(nodes, "nodes"))


def min_cut(spark, sf_dir):
    arcs, edges, nodes = _network(spark, sf_dir, "supplier")
    pairs = None
    for a, b in (("west", "east"), ("north", "south"), ("ids:0", "amenity:hospital")):
        for role, spec in (("source", a), ("sink", b)):
            part = network.zone(nodes, spec).select(F.lit(f"{a}>{b}").alias("od"), "id", F.lit(role).alias("role"))
            pairs = part if pairs is None else pairs.unionByName(part)
    return flow.min_cuts(edges.select("u", "v", "capacity"), pairs)


def flood_impact(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    return scenarios.flood_impact(edges, nodes, [LEVEL])


def flood_sweep(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    return scenarios.flood_impact(edges, nodes, SWEEP)


def lost_access(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    return scenarios.lost_access(edges, nodes, LEVEL)


def restoration_priority(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    return scenarios.restoration_priority(edges, nodes, LEVEL)


def robustness_random(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    return scenarios.random_attack(edges, nodes).select("step", F.round("fraction", 6).alias("fraction"), F.round("lcc", 6).alias("lcc"))


def robustness_targeted(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    found = scenarios.targeted_attack(written(edges, "edges"), written(nodes, "nodes"))
    return found.select("step", F.round("fraction", 6).alias("fraction"), F.round("lcc", 6).alias("lcc"))


def robustness_auc(spark, sf_dir):
    """One row for each strategy."""
    curves = robustness_random(spark, sf_dir).withColumn("strategy", F.lit("random")).unionByName(robustness_targeted(spark, sf_dir).withColumn("strategy", F.lit("targeted")))
    return stats.area_under(curves, "fraction", "lcc", ["strategy"]).select("strategy", F.round("auc", 6).alias("auc"))


def spearman(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("double").alias("a"), F.col("o_totalprice").alias("b"))
    return stats.spearman(docs, "a", "b").select(F.round("r", 6).alias("r"))


def pearson(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return stats.pearson(lines, "a", "b").select(F.round("r", 6).alias("r"))


def bpr_travel_time(spark, sf_dir):
    arcs, _, _ = _network(spark, sf_dir, "customer")
    volume = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("u")).agg((F.count("*") * 100.0).alias("volume"))
    loaded = arcs.join(volume, "u", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return loaded.select("u", "v", F.round(geo.bpr_time(F.col("travel_time_s"), F.col("volume"), F.col("capacity")), 4).alias("loaded_s"))


#: Two quadrilaterals over the derived grid, as shares of its pitch.
_QUADS = {"canopy": ((0.2, 0.3), (5.1, 0.1), (4.7, 4.2), (0.4, 3.6)), "shadow": ((2.5, 2.5), (8.3, 2.2), (7.9, 6.8), (3.1, 7.2))}


def _occluders(spark: SparkSession) -> DataFrame:
    rows = [(i, kind, [(networks.LON0 + x * networks.LON_STEP, networks.LAT0 + y * networks.LAT_STEP) for x, y in quad]) for i, (kind, quad) in enumerate(_QUADS.items())]
    return spark.createDataFrame(rows, "ord int, type string, polygon array<struct<x:double,y:double>>")


def point_in_polygon(spark, sf_dir):
    _, _, nodes = _network(spark, sf_dir, "customer")
    return repair.occluder_at(nodes.select("id", "x", "y"), _occluders(spark), "x", "y").select("id", "occluder")


def _also_far_north(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network and a copy of it under other ids at 71 degrees north, across the 180th meridian."""
    x = F.pmod(F.col("x") + 102.32 + 180, F.lit(360.0)) - 180
    moved = nodes.withColumns({"id": F.col("id") + 10_000_000, "x": x, "y": F.col("y") + 58})
    ends = edges.withColumns({"u": F.col("u") + 10_000_000, "v": F.col("v") + 10_000_000})
    return edges.unionByName(ends), nodes.unionByName(moved)


def gap_candidates(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    edges, nodes = _also_far_north(edges, nodes)
    found = repair.gap_candidates(edges, nodes, _occluders(spark))
    return found.select("a", "b", F.round("gap_m", 3).alias("gap_m"), F.round("straightness", 6).alias("straightness"))


def gap_closure(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "customer")
    log = repair.close_gaps(repair.gap_candidates(edges, nodes, _occluders(spark)))
    return log.select("a", "b", F.round("gap_m", 1).alias("gap_m"), F.round("straightness", 3).alias("straightness"), "occluder", "decision", "reason")


def flyover_split(spark, sf_dir):
    arcs, edges, nodes = _network(spark, sf_dir, "customer")
    tagged = edges.withColumns({"bridge": F.col("highway").isin("motorway", "trunk", "primary"), "layer": F.lit(0)})
    return repair.crossings(tagged, nodes)


def geo_match(spark, sf_dir):
    _, _, nodes = _network(spark, sf_dir, "customer")
    moved = nodes.select((F.col("id") + 1_000_000).alias("id"), (F.col("x") + 0.0002).alias("x"), (F.col("y") - 0.0001).alias("y"))
    return repair.nearest_match(nodes, moved).select("id", "match", F.round("distance_m", 3).alias("distance_m"))


def apls(spark, sf_dir):
    ways, nodes, _ = _paths(spark, sf_dir)
    truth = paths.shortest_paths(ways, _sources(nodes))
    damaged = written(ways.where((F.col("u") + F.col("v")) % 7 != 0), "damaged")
    return stats.path_agreement(truth, paths.shortest_paths(damaged, _sources(nodes))).select(F.round("apls", 6).alias("apls"))


def _pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the supplier grid on a raster of 12 pixels a cell, one row per street."""
    _, edges, _ = _network(spark, sf_dir, "supplier")
    w = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.floor(F.sqrt(F.count("*"))).cast("bigint").alias("side"))
    at = lambda c, f: (f(F.col(c), F.col("side")) * 12 + 6).cast("int")
    row, col = (lambda k, s: F.floor(k / s)), (lambda k, s: k % s)
    return edges.crossJoin(F.broadcast(w)).select(F.lit("t").alias("tile"), at("u", row).alias("r0"), at("u", col).alias("c0"), at("v", row).alias("r1"), at("v", col).alias("c1"))


_SIDE = 100_000


def rasterize(spark, sf_dir):
    """Streets along both axes, and beside each a slanted segment."""
    rows = _pixel_rows(spark, sf_dir)
    slanted = rows.withColumns({"r1": F.col("r1") + F.col("c0") % 9 - 4, "c1": F.col("c1") + F.col("r1") % 7 - 3})
    return raster.rasterize(rows.unionByName(slanted), _SIDE, _SIDE, 1)


def dilate(spark, sf_dir):
    return raster.dilate(raster.rasterize(_pixel_rows(spark, sf_dir), _SIDE, _SIDE, 0), 2, _SIDE, _SIDE)


def erode(spark, sf_dir):
    return raster.erode(raster.rasterize(_pixel_rows(spark, sf_dir), _SIDE, _SIDE, 2), 1)


def skeletonize_step(spark, sf_dir):
    return raster.thin_step(raster.rasterize(_pixel_rows(spark, sf_dir), _SIDE, _SIDE, 2), False)


def trace_degree(spark, sf_dir):
    bits = raster.neighbour_bits(raster.rasterize(_pixel_rows(spark, sf_dir), _SIDE, _SIDE, 0))
    return bits.groupBy(F.bit_count("bits").cast("bigint").alias("degree")).agg(F.count("*").alias("pixels"))


def vectorize(spark, sf_dir):
    nodes, edges = raster.vectorize(raster.rasterize(_pixel_rows(spark, sf_dir), _SIDE, _SIDE, 2), _SIDE, _SIDE, 1.0, 3.0)
    return edges.select(F.col("a.row").alias("row_a"), F.col("a.col").alias("col_a"), F.col("b.row").alias("row_b"), F.col("b.col").alias("col_b"), "steps", "diagonals")


def geojson_edges(spark, sf_dir):
    arcs, edges, nodes = _network(spark, sf_dir, "customer")
    return networks.edge_features(edges.withColumns({"length_m": F.round("length_m", 1), "travel_time_s": F.round("travel_time_s", 1)}), nodes, ["highway", "length_m", "travel_time_s"])


def top_segments(spark, sf_dir):
    """The five segments with the largest betweenness: a report whose limit is its purpose."""
    return edge_betweenness(spark, sf_dir).orderBy(F.desc("betweenness"), "u", "v").limit(5)


def highest_ground(spark, sf_dir):
    _, _, nodes = _network(spark, sf_dir, "customer")
    w = Window.partitionBy("amenity").orderBy(F.desc("elevation"), "id")
    return nodes.withColumn("place", F.row_number().over(w)).where("place <= 3").select("id", "elevation", F.coalesce("amenity", F.lit("none")).alias("amenity"), F.col("place").cast("bigint").alias("place"))


def analysis_summary(spark, sf_dir):
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    edges = written(edges, "edges")
    return reports.summary(edges, nodes, connectivity.articulation_points(edges), connectivity.bridges(edges))


def estimate_error(spark, sf_dir):
    """The sampled estimate over all draws against the exact measure."""
    ways, _, n = _paths(spark, sf_dir)
    found = reports.worst_error(progressive.merged(paths.sampled_betweenness(ways, _draws(spark, sf_dir, n), n)), paths.edge_betweenness(ways, n))
    return found.select(F.round("worst", 7).alias("worst"), F.round("mean", 7).alias("mean"), "shared")


def zone_capacity(spark, sf_dir):
    arcs, _, nodes = _network(spark, sf_dir, "customer")
    return reports.zone_capacity(arcs, zones(spark, sf_dir))


def saving_projection(spark, sf_dir):
    return progressive_epsilon(spark, sf_dir).select("batch", "samples", geo.saving(F.col("samples")).alias("saving"))


def edge_path_length(spark, sf_dir):
    """Length along each street with a bend of one metre figure to the north in its middle."""
    _, edges, nodes = _network(spark, sf_dir, "customer")
    a = nodes.select(F.col("id").alias("u"), F.struct("x", "y").alias("a"))
    b = nodes.select(F.col("id").alias("v"), F.struct("x", "y").alias("b"))
    bend = F.struct(((F.col("a.x") + F.col("b.x")) / 2).alias("x"), ((F.col("a.y") + F.col("b.y")) / 2 + 0.0005).alias("y"))
    return edges.select("u", "v").join(a, "u").join(b, "v").select("u", "v", F.round(geo.path_length_m(F.array("a", bend, "b")), 3).alias("length_m"))


def _damaged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The supplier network with every eleventh street hidden in its middle third below occluders, repaired and held against itself.

    Streets are taken by rank, so networks of any size have hidden ones.  As many other streets have no middle third in truth; nothing covers theirs, so they must stay open.
    """
    _, edges, nodes = _network(spark, sf_dir, "supplier")
    kind = F.pmod(F.col("rank") - 1, F.lit(11))
    street = stats.with_rank(edges, F.xxhash64("u", "v")).select("u", "v", "highway", kind.alias("kind"), (F.col("u") * 2 + (F.col("v") - F.col("u") > 1).cast("int")).alias("k"))
    street = written(street.withColumns({"a": F.col("k") * 2 + 1_000_000, "b": F.col("k") * 2 + 1_000_001}), "streets")
    part = lambda p, q: F.struct(F.col(p).alias("u"), F.col(q).alias("v"))
    parts = F.when(F.col("kind") == 0, F.array(part("u", "a"), part("a", "b"), part("b", "v"))).when(F.col("kind") == 1, F.array(part("u", "a"), part("b", "v"))).otherwise(F.array(part("u", "v")))
    roads = street.select("highway", F.explode(parts).alias("p")).select("p.u", "p.v", "highway", F.lit(None).cast("boolean").alias("bridge"), F.lit(None).cast("int").alias("layer"))
    p, q = nodes.select(F.col("id").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0")), nodes.select(F.col("id").alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    at = lambda c, t: F.struct(F.col(c).alias("id"), (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"))
    added = street.where("kind < 2").join(p, "u").join(q, "v").select(F.explode(F.array(at("a", 1 / 3), at("b", 2 / 3))).alias("n")).select("n.*")
    places = written(nodes.select("id", "x", "y").unionByName(added), "places")
    roads = written(roads, "roads")
    labels = street.where("kind < 2").select("a", "b", (F.col("kind") == 0).alias("real"))
    hidden = street.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    none = spark.createDataFrame([], "id bigint, split boolean")
    return reports.repair_run(roads, places, written(reports.damage(roads, hidden), "damaged"), places, reports.occluders_over(hidden, places), labels, none)


def repair_run(spark, sf_dir):
    return _damaged(spark, sf_dir)["metrics"]


def repair_features(spark, sf_dir):
    run = _damaged(spark, sf_dir)
    return reports.repair_features(run["edges"], run["nodes"], run["log"])


_ALL = (
    flood_impact, annotate_edges, undirected_view, collapse_parallel, bipartite_degree, zones, elevation, degree, submerged_edges, components, component_summary, bridges, articulation_points,
    two_edge_components, three_edge_components, apsp, sssp_hops, sigma_counts, global_efficiency, edge_betweenness, edge_betweenness_directed, node_betweenness, sampled_betweenness, streamed_betweenness, progressive_epsilon, current_flow,
    removal_impact, resilience_score, min_cut, flood_sweep, lost_access, restoration_priority, robustness_random, robustness_targeted, robustness_auc, spearman, pearson, bpr_travel_time, point_in_polygon, gap_candidates,
    gap_closure, flyover_split, geo_match, apls, rasterize, dilate, erode, skeletonize_step, trace_degree, vectorize, geojson_edges, top_segments, highest_ground,
    analysis_summary, estimate_error, zone_capacity, saving_projection, edge_path_length, repair_run, repair_features,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
