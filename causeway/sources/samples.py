"""Named sample networks in a folder, ground rasters, and masks as a camera would see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import raster
from causeway.sources import networks


def available(spark: SparkSession, folder: str) -> DataFrame:
    """``(name)`` of the GeoJSON files in a folder of any store Spark reads, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.geojson").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.geojson$", 1).alias("name")).orderBy("name")


def load(spark: SparkSession, folder: str, name: str) -> networks.Network:
    """The named sample; ``FileNotFoundError`` lists what there is."""
    names = [r["name"] for r in available(spark, folder).collect()]
    if name not in names:
        raise FileNotFoundError(f"no sample {name!r}; available: {', '.join(names) or 'none'}")
    return networks.from_geojson(spark, f"{folder.rstrip('/')}/{name}.geojson")


def with_ground(nodes: DataFrame, dem: DataFrame, lon0: float, lat0: float, step: float) -> DataFrame:
    """Nodes with the elevation of the raster cell (row, col, elevation) they lie in; rows run southwards from lat0.

    Nodes outside the raster keep the elevation they have.
    """
    cell = nodes.withColumns({"row": F.floor((F.lit(lat0) - F.col("y")) / step), "col": F.floor((F.col("x") - lon0) / step)})
    found = cell.join(dem.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("elevation").alias("_ground")), ["row", "col"], "left")
    return found.withColumn("elevation", F.coalesce("_ground", "elevation")).select(*nodes.columns)


def tile_of(nodes: DataFrame, target_px: int = 400, pad: float = 0.06) -> dict[str, float]:
    """A north-up frame around the nodes: lon0, lat0 (upper left), degrees a pixel, height and width."""
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    span = max(box["x1"] - box["x0"], box["y1"] - box["y0"])
    edge = pad * span or 1e-4
    step = (span + 2 * edge) / target_px
    size = lambda a, b: int(-(-(b - a + 2 * edge) // step))
    return {"lon0": box["x0"] - edge, "lat0": box["y1"] + edge, "step": step, "height": size(box["y0"], box["y1"]), "width": size(box["x0"], box["x1"])}


def segments_of(edges: DataFrame, nodes: DataFrame, tile: dict[str, float], name: str = "t") -> DataFrame:
    """Edges as pixel segments (tile, r0, c0, r1, c1); pixels truncate towards the frame's corner."""
    place = nodes.select("id", ((F.lit(tile["lat0"]) - F.col("y")) / tile["step"]).cast("int").alias("r"), ((F.col("x") - tile["lon0"]) / tile["step"]).cast("int").alias("c"))
    a = place.select(F.col("id").alias("u"), F.col("r").alias("r0"), F.col("c").alias("c0"))
    b = place.select(F.col("id").alias("v"), F.col("r").alias("r1"), F.col("c").alias("c1"))
    return edges.select("u", "v").join(a, "u").join(b, "v").select(F.lit(name).alias("tile"), "r0", "c0", "r1", "c1")


def node_places(nodes: DataFrame, tile: dict[str, float]) -> DataFrame:
    """Traced nodes (row, col) with x and y at pixel centres."""
    return nodes.withColumns({"x": F.lit(tile["lon0"]) + (F.col("col") + 0.5) * tile["step"], "y": F.lit(tile["lat0"]) - (F.col("row") + 0.5) * tile["step"]})


def imperfect_mask(edges: DataFrame, nodes: DataFrame, tile: dict[str, float], occluders: DataFrame, radius: int = 3, dropout: float = 0.02, speckle: float = 0.0015, seed: int = 0) -> DataFrame:
    """The mask of a network as an occluded, noisy camera gives it.

    Pixels below occluders (tile, polygon in pixels) go; of the rest, a share goes and false pixels
    come, both by a hash of place and seed, so that a mask is the same every time.
    """
    height, width = int(tile["height"]), int(tile["width"])
    seen = raster.covered(raster.rasterize(segments_of(edges, nodes, tile), height, width, radius), occluders)
    share = lambda: F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    spark = edges.sparkSession
    noise = spark.range(0, height * width).select(F.lit("t").alias("tile"), F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return seen.where(share() >= dropout).unionByName(noise.where(share() >= 1 - speckle)).distinct()
