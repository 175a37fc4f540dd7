"""Scans of frame caches, labels, images and archives, through Spark's own file readers.

Files come as binaryFile rows, so any store that Spark reads will do. Decoding is pluggable where it needs a codec.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

FRAMES = "scene string, split string, video string, t int, h int, w int, channels int, px binary"
_PATH = r"([^/]+)/([^/]+)/([^/]+)\.npy$"


def read_cache(spark: SparkSession, root: str, split: str = "*") -> DataFrame:
    """Frames of `<root>/<scene>/<split>/<video>.npy`, arrays of (N, H, W) or (N, H, W, 3) bytes. One task holds one video."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, part, video, content in zip(batch["scene"], batch["split"], batch["video"], batch["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                n, h, w = a.shape[:3]
                for i in range(0, n, 256):
                    own = a[i : i + 256]
                    yield pd.DataFrame({"scene": scene, "split": part, "video": video, "t": np.arange(i, i + len(own), dtype=np.int32), "h": h, "w": w, "channels": a.shape[3] if a.ndim == 4 else 1, "px": [f.tobytes() for f in own]})

    files = spark.read.format("binaryFile").load(f"{root}/*/{split}/*.npy")
    part = lambda i: F.regexp_extract("path", _PATH, i)
    return files.select(part(1).alias("scene"), part(2).alias("split"), part(3).alias("video"), "content").mapInPandas(decode, FRAMES)


def read_labels(spark: SparkSession, paths: str) -> DataFrame:
    """scene, video, t, y from `<scene>/gt.json` files: {video: [0, 1, ...]}."""
    text = spark.read.text(paths, wholetext=True).withColumn("scene", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))
    rows = text.select("scene", F.explode(F.from_json("value", "map<string,array<int>>")).alias("video", "labels"))
    return rows.select("scene", "video", F.posexplode("labels").alias("t", "y")).withColumn("y", F.col("y").cast("tinyint"))


def label_ranges(ranges: DataFrame, text: str, ids: list[str]) -> DataFrame:
    """ids, ordinal, start, stop: the a:b entries of each `gt_frame = [...]` of a text, 1-based and inclusive, as 0-based frames.

    ordinal is the position of the entry's list in the text, by which videos are matched.
    """
    lists = ranges.select(*ids, F.posexplode(F.regexp_extract_all(text, F.lit(r"gt_frame\s*=\s*\[([^\]]*)\]"), F.lit(1))).alias("ordinal", "_list"))
    pairs = lists.select(*ids, "ordinal", F.explode(F.regexp_extract_all("_list", F.lit(r"(\d+\s*:\s*\d+)"), F.lit(1))).alias("_pair"))
    ends = F.split("_pair", r"\s*:\s*")
    return pairs.select(*ids, "ordinal", (ends[0].cast("int") - 1).alias("start"), (ends[1].cast("int") - 1).alias("stop"))


def frame_labels(frames: DataFrame, ranges: DataFrame, keys: list[str], time: str) -> DataFrame:
    """frames with y: 1 inside a range. Ranges are exploded to frames, so that the join is on equal keys."""
    inside = ranges.select(*keys, F.explode(F.sequence("start", "stop")).alias(time)).distinct().withColumn("y", F.lit(1))
    return frames.join(inside, [*keys, time], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def read_images(spark: SparkSession, glob: str, pattern: str, names: list[str], decode: Callable[[bytes], np.ndarray | None]) -> DataFrame:
    """Frames from single image files. pattern's groups are called names, which must hold video.

    decode returns (H, W) bytes or None; an unreadable frame repeats the last readable one before it.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [decode(c) for c in batch["content"]]
            out = batch.drop(columns=["content"])
            yield out.assign(h=[None if a is None else a.shape[0] for a in images], w=[None if a is None else a.shape[1] for a in images], px=[None if a is None else a.astype(np.uint8).tobytes() for a in images])

    files = spark.read.format("binaryFile").load(glob)
    cut = files.select("path", *(F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)), "content")
    rows = cut.mapInPandas(each, f"path string, {', '.join(f'{n} string' for n in names)}, h int, w int, px binary")
    keys = [n for n in names if n in ("scene", "split", "video")]
    order = Window.partitionBy(*keys).orderBy("path")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    # places come from names alone; pixels aren't sorted, and only those that stand for an unreadable frame are moved
    rows = checkpointed(rows)
    placed = rows.select("path", *keys, F.when(F.col("h").isNotNull(), F.col("path")).alias("_read"))
    placed = placed.withColumn("t", F.row_number().over(order) - 1).withColumn("_from", F.last("_read", ignorenulls=True).over(back))
    own = rows.where("h is not null").join(placed.where("_read is not null").select("path", "t"), "path")
    gaps = placed.where("_read is null").select(*keys, "t", F.col("_from").alias("path"))
    filled = gaps.join(rows.select("path", "h", "w", "px"), "path", "left")
    return own.select(*keys, "t", "h", "w", "px").unionByName(filled.select(*keys, "t", "h", "w", "px"))


def decode_pgm(content: bytes) -> np.ndarray | None:
    """A binary greyscale PGM image; None if it isn't one."""
    parts = content.split(maxsplit=4)
    try:
        w, h = int(parts[1]), int(parts[2])
        return np.frombuffer(content[len(content) - w * h :], np.uint8).reshape(h, w) if parts[0] == b"P5" else None
    except (IndexError, ValueError):
        return None


def constant_size(frames: DataFrame, scene: list[str]) -> DataFrame:
    """Scenes whose frames differ in size: there should be none."""
    return frames.groupBy(*scene).agg(F.count_distinct("h", "w").alias("sizes")).where("sizes > 1")


def decimate(frames: DataFrame, source_rate: float, rate: float, time: str = "t") -> DataFrame:
    """Every n-th frame of a file, n being the rounded ratio of the two rates (1 at least)."""
    return frames.where(F.col(time) % max(1, round(source_rate / rate)) == 0)


def read_results(spark: SparkSession, paths: str) -> DataFrame:
    """run, detector, post, auc, eer from results.json files, whose auc map is keyed `<detector>/<post>`."""
    schema = "auc map<string,struct<auc: double, eer: double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(paths)
    rows = rows.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+/[^/]+$", 1).alias("run"), F.explode("auc").alias("_key", "_v"))
    return rows.select("run", F.split("_key", "/")[0].alias("detector"), F.split("_key", "/")[1].alias("post"), "_v.auc", "_v.eer")
