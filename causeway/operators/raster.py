"""Road masks as sparse pixel relations ``(tile, row, col)``, and networks out of them.

Every step is a join or a grouping by pixel; nothing holds a dense image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import geo
from causeway.plans.components import connected_components
from causeway.plans.durable import discard, written

#: Neighbours clockwise from north: (row step, column step) for bits 0 to 7.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
KEYS = ["tile", "row", "col"]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def _shifted(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    return pixels.withColumn("_o", F.explode(steps)).select("tile", (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"))


def binarise(probabilities: DataFrame, cut: float = 0.5) -> DataFrame:
    """Pixels of a sparse probability mask (tile, row, col, p) whose probability exceeds ``cut``."""
    return probabilities.where(F.col("p") > cut).select(KEYS)


def clip(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def rasterize(segments: DataFrame, height: int, width: int, radius: int = 3) -> DataFrame:
    """Pixels of segments (tile, r0, c0, r1, c1), thickened by a disk: one pixel per step along the longer axis.

    A step that falls midway between two pixels takes the one nearer to the start.
    """
    dr, dc = F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")
    n = F.greatest(F.abs(dr), F.abs(dc))

    def along(start: Column, d: Column) -> Column:
        part = F.floor((2 * F.col("k") * F.abs(d) + n - 1) / (2 * F.greatest(n, F.lit(1))))
        return (start + F.signum(d).cast("int") * part).cast("int")

    line = segments.withColumn("k", F.explode(F.sequence(F.lit(0), n))).select("tile", along(F.col("r0"), dr).alias("row"), along(F.col("c0"), dc).alias("col"))
    return dilate(line.distinct(), radius, height, width)


def dilate(pixels: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    return clip(_shifted(pixels, disk(radius)), height, width).distinct()


def erode(pixels: DataFrame, radius: int) -> DataFrame:
    """Pixels whose whole disk is set; outside the image nothing is."""
    offsets = disk(radius)
    return _shifted(pixels.select(KEYS).distinct(), [(-r, -c) for r, c in offsets]).groupBy(KEYS).count().where(F.col("count") == len(offsets)).select(KEYS)


def clean(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Closed, then opened, by a disk of radius 1."""
    closed = erode(dilate(pixels, 1, height, width), 1)
    return dilate(erode(closed, 1), 1, height, width)


def neighbour_bits(pixels: DataFrame) -> DataFrame:
    """Each set pixel with the bits of its set neighbours, in one grouping."""
    marks = F.array(*[F.struct(F.lit(-r).alias("r"), F.lit(-c).alias("c"), F.lit(1 << i).alias("b")) for i, (r, c) in enumerate(AROUND)], F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(256).alias("b")))
    told = pixels.withColumn("_m", F.explode(marks)).select("tile", (F.col("row") + F.col("_m.r")).alias("row"), (F.col("col") + F.col("_m.c")).alias("col"), F.col("_m.b").alias("b"))
    return told.groupBy(KEYS).agg(F.bit_or("b").alias("bits")).where("bits >= 256").withColumn("bits", F.col("bits").bitwiseAND(255))


def thin_step(pixels: DataFrame, second: bool) -> DataFrame:
    """One sub-iteration of Zhang and Suen's thinning: all its deletions are decided on one snapshot."""
    rows = neighbour_bits(pixels)
    m = F.col("bits")
    turned = F.shiftrightunsigned(m, 1).bitwiseOR(F.shiftleft(m.bitwiseAND(1), 7))
    count, rises = F.bit_count(m), F.bit_count(turned.bitwiseAND(255 - m))

    def all_set(*bits: int) -> Column:
        mask = sum(1 << b for b in bits)
        return m.bitwiseAND(mask) == mask

    blocked = (all_set(0, 2, 6) | all_set(0, 4, 6)) if second else (all_set(0, 2, 4) | all_set(2, 4, 6))
    return rows.where(~(count.between(2, 6) & (rises == 1) & ~blocked)).select(KEYS)


def skeletonize(pixels: DataFrame) -> DataFrame:
    spark = pixels.sparkSession
    now = written(pixels.select(KEYS).distinct(), "mask")
    size = now.count()
    while True:
        after = written(thin_step(thin_step(now, False), True), "mask")
        left = after.count()
        discard(spark, now)
        now = after
        if left == size:
            return now
        size = left


def _adjacent(pixels: DataFrame) -> DataFrame:
    """Pairs (a, b) of set neighbours as structs, each once, with the number of axes they differ in."""
    half = [AROUND[i] for i in (1, 2, 3, 4)]
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in half])
    here = pixels.select("tile", F.struct(KEYS).alias("a"), F.explode(steps).alias("o")).select("tile", "a", (F.col("a.row") + F.col("o.r")).alias("row"), (F.col("a.col") + F.col("o.c")).alias("col"))
    return here.join(pixels.select(KEYS), KEYS).select("a", F.struct(KEYS).alias("b"))


def trace(skeleton: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, tile, row, col)`` and edges ``(tile, a, b, steps, diagonals)`` of a skeleton.

    Pixels with other than two neighbours are node pixels; those that touch make one node, at their mean place, named
    by its smallest pixel.  Chains of the others join the nodes at their ends; chains that meet one node only, or more than
    two, are left out, and so are rings without a node.  Of parallel chains the shortest stays.
    """
    bits = written(neighbour_bits(skeleton), "bits")
    node = bits.where(F.bit_count("bits") != 2).select(KEYS)
    chain = bits.where(F.bit_count("bits") == 2).select(KEYS)
    pixel = F.struct(KEYS).alias("pixel")
    joined = connected_components(_adjacent(node)).withColumnRenamed("node", "pixel")
    clusters = written(node.select(pixel).join(joined, "pixel", "left").select("pixel", F.coalesce("component", "pixel").alias("cluster")), "clusters")
    linked = connected_components(_adjacent(chain)).withColumnRenamed("node", "pixel")
    chains = written(chain.select(pixel).join(linked, "pixel", "left").select("pixel", F.coalesce("component", "pixel").alias("chain")), "chains")
    nodes = clusters.groupBy("cluster").agg(F.avg("pixel.row").alias("row"), F.avg("pixel.col").alias("col")).select(F.col("cluster").alias("id"), F.col("cluster.tile").alias("tile"), "row", "col")
    pairs = written(_adjacent(skeleton), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    diagonal = ((F.col("a.row") != F.col("b.row")) & (F.col("a.col") != F.col("b.col"))).cast("int")
    from_chain = both.withColumn("diagonal", diagonal).join(chains.withColumnRenamed("pixel", "a"), "a")
    ends = from_chain.join(clusters.withColumnRenamed("pixel", "b"), "b").groupBy("chain").agg(F.array_sort(F.collect_set("cluster")).alias("ends"), F.count("*").alias("n"), F.sum("diagonal").alias("d"))
    inner = from_chain.join(chains.select(F.col("pixel").alias("b"), F.col("chain").alias("same")), "b").where("same = chain and a < b").groupBy("chain").agg(F.count("*").alias("n_in"), F.sum("diagonal").alias("d_in"))
    found = ends.where(F.size("ends") == 2).join(inner, "chain", "left").select(
        F.col("chain.tile").alias("tile"), F.col("ends")[0].alias("a"), F.col("ends")[1].alias("b"),
        (F.col("n") + F.coalesce("n_in", F.lit(0))).alias("steps"), (F.col("d") + F.coalesce("d_in", F.lit(0))).alias("diagonals"),
    )
    length = F.col("steps") + (F.sqrt(F.lit(2.0)) - 1) * F.col("diagonals")
    shortest = found.groupBy("tile", "a", "b").agg(F.min_by(F.struct("steps", "diagonals"), length).alias("m"))
    return nodes, shortest.select("tile", "a", "b", "m.steps", "m.diagonals")


def prune(nodes: DataFrame, edges: DataFrame, length: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """Drop dangling edges shorter than ``least`` until none is left, then nodes without edges."""
    kept = written(edges.withColumn("_length", length), "edges")
    while True:
        degree = kept.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
        a, b = degree.select(F.col("id").alias("a"), F.col("count").alias("da")), degree.select(F.col("id").alias("b"), F.col("count").alias("db"))
        marked = written(kept.join(a, "a").join(b, "b").withColumn("_spur", (F.least("da", "db") == 1) & (F.col("_length") < least)), "spurs")
        if marked.where("_spur").isEmpty():
            break
        kept = written(marked.where("not _spur").select(*kept.columns), "edges")
    used = kept.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return nodes.join(used, "id", "left_semi"), kept.drop("_length")


def vectorize(pixels: DataFrame, height: int, width: int, metres: float = 1.0, least: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """A network from a mask: cleaned, thinned, traced and pruned; ``metres`` is a pixel's size."""
    nodes, edges = trace(skeletonize(clean(pixels, height, width)))
    length = (F.col("steps") + (F.sqrt(F.lit(2.0)) - 1) * F.col("diagonals")) * F.lit(metres)
    return prune(nodes, edges.withColumn("length_m", length), F.col("length_m"), least)


def covered(pixels: DataFrame, occluders: DataFrame) -> DataFrame:
    """Pixels outside all polygons (tile, polygon of struct(x: column, y: row)): what an occluded camera still sees."""
    hit = pixels.join(occluders.select("tile", "polygon"), "tile").where(geo.inside(F.col("col").cast("double"), F.col("row").cast("double"), F.col("polygon"))).select(KEYS).distinct()
    return pixels.join(hit, KEYS, "left_anti")
