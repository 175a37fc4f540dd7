"""Maps over a pixel or cell grid: rows of (frame keys, y, x, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def cell_id(y: Column, x: Column, cell: int, width: int) -> Column:
    """The number of the cell that holds a pixel, row by row over a grid of ceil(width / cell) columns."""
    return (F.floor(y / cell) * (-(-width // cell)) + F.floor(x / cell)).cast("int")


def dense(maps: DataFrame, frames: Keys, value: str, height: int, width: int) -> DataFrame:
    """maps with every position of every frame; positions without a row are 0."""
    every = maps.select(*frames).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return every.join(maps.select(*frames, "y", "x", value), [*frames, "y", "x"], "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))


def window_sums(maps: DataFrame, frames: Keys, value: str, height: int, width: int, size: int, out: str) -> DataFrame:
    """Sums over size x size windows at every position of a zero border of size // 2.

    An even window has one more position than the map along each axis. Two sums over bounded frames, one for each axis.
    """
    more = 1 - size % 2
    rows = dense(maps, frames, value, height + more, width + more)
    back, ahead = size // 2, size - 1 - size // 2
    down = Window.partitionBy(*frames, "x").orderBy("y").rowsBetween(-back, ahead)
    across = Window.partitionBy(*frames, "y").orderBy("x").rowsBetween(-back, ahead)
    return rows.withColumn("_column", F.sum(value).over(down)).withColumn(out, F.sum("_column").over(across)).drop("_column")


def frame_score(maps: DataFrame, frames: Keys, value: str, height: int, width: int, size: int, out: str = "score", roi: DataFrame | None = None) -> DataFrame:
    """The largest local mean of each frame. roi (y, x, m) multiplies the map first, with 0 where it has no row."""
    if roi is not None:
        maps = maps.join(roi, ["y", "x"], "left").withColumn(value, F.col(value) * F.coalesce("m", F.lit(0))).drop("m")
    return window_sums(maps, frames, value, height, width, size, "_sum").groupBy(*frames).agg((F.max("_sum") / (size * size)).alias(out))


def scan_statistic(cells: DataFrame, frames: Keys, value: str, height: int, width: int, size: int = 6, out: str = "score") -> DataFrame:
    """The largest window sum of each frame's cells."""
    return window_sums(cells, frames, value, height, width, size, "_sum").groupBy(*frames).agg(F.max("_sum").alias(out))


def closing(maps: DataFrame, frames: Keys, value: str, out: str, size: int = 5) -> DataFrame:
    """Grey closing: largest, then smallest value of size x size windows that end at the map's border."""
    half = size // 2
    down = Window.partitionBy(*frames, "x").orderBy("y").rangeBetween(-half, half)
    across = Window.partitionBy(*frames, "y").orderBy("x").rangeBetween(-half, half)
    rows = maps.withColumn("_a", F.max(value).over(down)).withColumn("_b", F.max("_a").over(across))
    return rows.withColumn("_c", F.min("_b").over(down)).withColumn(out, F.min("_c").over(across)).drop("_a", "_b", "_c")


def pool_cells(maps: DataFrame, frames: Keys, value: str, cell: int, width: int) -> DataFrame:
    """frames, cell_id, sum_mean (sum over the cell's full area, whatever part of it is on the map), valid_mean, largest."""
    rows = maps.withColumn("cell_id", cell_id(F.col("y"), F.col("x"), cell, width))
    return rows.groupBy(*frames, "cell_id").agg((F.sum(value) / (cell * cell)).alias("sum_mean"), F.avg(value).alias("valid_mean"), F.max(value).alias("largest"))


def upsample(cells: DataFrame, frames: Keys, value: str, grid_height: int, grid_width: int, height: int, width: int) -> DataFrame:
    """Each cell's value at its pixels: cells (frames, cell_id) become maps (frames, y, x)."""
    tall, wide = -(-height // grid_height), -(-width // grid_width)
    rows = cells.withColumn("_y", F.floor(F.col("cell_id") / grid_width) * tall).withColumn("_x", F.col("cell_id") % grid_width * wide)
    rows = rows.withColumn("_dy", F.explode(F.sequence(F.lit(0), F.lit(tall - 1)))).withColumn("_dx", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    rows = rows.withColumn("y", (F.col("_y") + F.col("_dy")).cast("int")).withColumn("x", (F.col("_x") + F.col("_dx")).cast("int"))
    return rows.where((F.col("y") < height) & (F.col("x") < width)).select(*frames, "y", "x", value)


def coarse_view(maps: DataFrame, frames: Keys, value: str, height: int, width: int, block: int = 8) -> DataFrame:
    """frames, i, mean: means over whole blocks, numbered row by row; rows and columns that fill no block are dropped."""
    rows = maps.where((F.col("y") < height // block * block) & (F.col("x") < width // block * block))
    return rows.groupBy(*frames, cell_id(F.col("y"), F.col("x"), block, width // block * block).alias("i")).agg(F.avg(value).alias("mean"))


def patch_starts(size: int, patch: int, stride: int) -> list[int]:
    """Starts of the patches that cover an axis; it is padded at its end so that the last one fits."""
    pad = (stride - (size - patch) % stride) % stride if size > patch else patch - size
    return list(range(0, size + pad - patch + 1, stride))


def patches_to_map(patches: DataFrame, frames: Keys, value: str, height: int, width: int, patch: int, stride: int) -> DataFrame:
    """Mean at each pixel of the values of the patches (frames, py, px: their starts) that cover it."""
    offsets = F.sequence(F.lit(0), F.lit(patch - 1))
    rows = patches.withColumn("_dy", F.explode(offsets)).withColumn("_dx", F.explode(offsets))
    rows = rows.select(*frames, (F.col("py") + F.col("_dy")).alias("y"), (F.col("px") + F.col("_dx")).alias("x"), value)
    return rows.where((F.col("y") < height) & (F.col("x") < width)).groupBy(*frames, "y", "x").agg(F.avg(value).alias(value))


def extract_patches(maps: DataFrame, frames: Keys, value: str, height: int, width: int, patch: int, stride: int) -> DataFrame:
    """frames, py, px, values: the patches at every start, row by row, mirrored (without the edge) beyond the end."""
    spark = maps.sparkSession
    axes = []
    for name, size in (("y", height), ("x", width)):
        cover = [(s, d, a if (a := s + d) < size else 2 * size - 2 - a) for s in patch_starts(size, patch, stride) for d in range(patch)]
        axes.append(spark.createDataFrame(cover, f"p{name} int, _d{name} int, {name} int"))
    rows = maps.join(F.broadcast(axes[0]), "y").join(F.broadcast(axes[1]), "x")  # a row per position of an axis and patch
    ordered = F.array_sort(F.collect_list(F.struct((F.col("_dy") * patch + F.col("_dx")).alias("i"), F.col(value).cast("double").alias("v"))))
    return rows.groupBy(*frames, "py", "px").agg(F.transform(ordered, lambda s: s["v"]).alias("values"))
