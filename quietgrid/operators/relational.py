"""Joins that decide work and align tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """keys, fp: the payload's length and CRC-32."""
    raw = F.col(payload).cast("binary")
    return df.select(*keys, F.concat_ws(":", F.octet_length(raw), F.crc32(raw)).alias("fp"))


def stale(fingerprints: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of fingerprints whose work must be done: not in the cache, or there with another fingerprint.

    A cached row without a fingerprint counts as valid.
    """
    ready = cached.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("fp").alias("_fp"))
    on = (F.col("_fp").isNull() | (F.col("_fp") == F.col("fp")))
    for k in keys:
        on = on & (F.col(f"_{k}") == F.col(k))
    return fingerprints.join(ready, on, "left_anti")


def missing_outputs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows without an output."""
    return wanted.join(done, keys, "left_anti")


def labelled(frames: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with their labels: only as far as both reach."""
    return frames.join(labels, keys)


def length_mismatches(frames: DataFrame, labels: DataFrame, video: str) -> DataFrame:
    """video, frames, labels of videos whose two lengths differ: what labelled() cuts off."""
    a, b = frames.groupBy(video).agg(F.count("*").alias("frames")), labels.groupBy(video).agg(F.count("*").alias("labels"))
    return a.join(b, video, "full").select(video, F.coalesce("frames", F.lit(0)).cast("long").alias("frames"), F.coalesce("labels", F.lit(0)).cast("long").alias("labels")).where("frames <> labels")


def unlabelled(videos: DataFrame, labels: DataFrame, video: str) -> DataFrame:
    """Videos without any label."""
    return videos.join(labels.select(video).distinct().withColumn("_has", F.lit(True)), video, "left").where("_has is null").drop("_has")


def available(scores: DataFrame, videos: DataFrame, video: str) -> DataFrame:
    """Scores of the videos at hand."""
    return scores.join(videos, video, "left_semi")
