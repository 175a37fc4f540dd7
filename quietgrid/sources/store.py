"""Tables that the engine keeps between jobs: features with fingerprints, and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import fingerprint, stale


def read_scores(spark: SparkSession, path: str, detectors: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """scene, det, video, t, score of a table partitioned by det. Both filters prune its folders."""
    rows = spark.read.parquet(path)
    if detectors is not None:
        rows = rows.where(F.col("det").isin(detectors))
    return rows.where(F.col("det").startswith(prefix)) if prefix else rows


def refresh_features(inputs: DataFrame, cache: str, keys: list[str], payload: str, compute: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Features of inputs, from the cache where their fingerprint is there already; others are computed and added.

    compute maps rows of inputs to rows with keys and its features. A key whose payload changed has rows under two
    fingerprints in the cache; only those under the present one are returned. The cache is partitioned by feature name.
    """
    spark = inputs.sparkSession
    present = fingerprint(inputs, keys, payload)
    path = f"{cache}/name={name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    todo = stale(present, spark.read.parquet(path).select(*keys, "fp").distinct(), keys) if exists else present
    compute(inputs.join(todo.select(*keys), keys, "left_semi")).join(todo, keys).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(present, [*keys, "fp"], "left_semi").drop("fp")
