"""Queries that write caches and archives of the driver's tables and scan them back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import grid as G
from ..session import folder
from ..sources import archives
from ..sources.cache import FrameCache, write_cache
from .bindings import HEIGHT, MAPS, WIDTH, maps, table
from .register import query


def month_frames(spark, sf_dir):
    """scene, split, video (a year), t (a month), h, w, channels, px: the months' maps as frames of bytes."""
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.col("v") + 128))).cast("int")
    dense = G.dense(maps(spark, sf_dir), ["frame"], "v", HEIGHT, WIDTH).select("frame", (F.col("y") * WIDTH + F.col("x")).alias("i"), level.alias("level"))
    px = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "level"))), lambda s: F.lpad(F.hex(s["level"]), 2, "0")), ""))
    rows = dense.groupBy("frame").agg(px.alias("px"))
    place = F.row_number().over(G.Window.partitionBy(F.floor(F.col("frame") / 12)).orderBy("frame")) - 1
    return rows.select(F.lit("months").alias("scene"), F.when(F.col("frame") % 24 < 12, "train").otherwise("test").alias("split"), F.floor(F.col("frame") / 12).cast("string").alias("video"), place.cast("int").alias("t"), F.lit(HEIGHT).alias("h"), F.lit(WIDTH).alias("w"), F.lit(1).alias("channels"), "px")


def level_sums(frames):
    """Each frame's sum of bytes, weighed by position, in place of its pixels."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals = [int((np.frombuffer(p, np.uint8).astype(np.int64) * np.arange(1, len(p) + 1)).sum()) for p in b["px"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["split"], b["video"], b["t"], pa.array(totals, pa.int64())], names=["split", "video", "t", "total"])

    return frames.select("split", "video", "t", "px").mapInArrow(task, "split string, video string, t int, total long")


@query(f"""WITH {MAPS}, l AS (SELECT frame, y * 10 + x AS i, greatest(0, least(255, round(v + 128)))::INT AS level FROM dense)
SELECT CASE WHEN frame % 24 < 12 THEN 'train' ELSE 'test' END AS split, (frame // 12)::VARCHAR AS video, (row_number() OVER (PARTITION BY frame // 12 ORDER BY frame) - 1)::INT AS t, sum(level * (i + 1))::BIGINT AS total
FROM l GROUP BY frame""")
def cached_frames(spark, sf_dir):
    """Maps written as `.npy` videos and scanned back by ranges of bytes."""
    root = folder(spark, "cache")
    write_cache(month_frames(spark, sf_dir), root)
    spark.dataSource.register(FrameCache)
    return level_sums(spark.read.format("frame_cache").option("partBytes", 256).load(root))


@query("SELECT 'page-' || page_id || '.html' AS name, strlen(coalesce(html, ''))::BIGINT AS bytes, md5(coalesce(html, '')) AS md5 FROM pages")
def archive_members(spark, sf_dir):
    """Pages written to deflated archives, whose members are read back by ranges of bytes."""
    root = folder(spark, "archives")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    archives.write_archives(pages, root)
    rows = archives.read_archives(spark, f"{root}/*.zip", r"\.html$")
    return rows.select("name", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("md5"))
