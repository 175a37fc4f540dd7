"""The engine's concepts on the driver's tables, as frames and as the same SQL text.

Cameras are users of `events`, a frame is an event in order of time, an anomaly is an error. Cell maps come from `lineitem`:
a frame is a month of shipping, a position is (supplier mod 12, part mod 10), a value is the month's quantity over 25.5 a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEIGHT, WIDTH = 12, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video, t (from 0), y, x = ln(1 + value), k (a second channel), event_type, value, ts."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("video"),
        (F.row_number().over(order) - 1).alias("t"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.log1p("value").alias("x"),
        F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("double").alias("k"),
        "event_type",
        "value",
        "ts",
    )


FRAMES = """frames AS (
  SELECT event_id, user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         (event_type = 'error')::INT AS y, ln(1 + value) AS x, regexp_extract(props, '"k": ([0-9]+)', 1)::DOUBLE AS k, event_type, value, ts
  FROM events)"""


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, y, x, v."""
    rows = table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("frame"), (F.col("l_suppkey") % HEIGHT).cast("int").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x"), "l_quantity")
    return rows.groupBy("frame", "y", "x").agg(F.sum(F.col("l_quantity") - 25.5).alias("v"))


MAPS = """maps AS (
  SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INT AS frame, (l_suppkey % 12)::INT AS y, (l_partkey % 10)::INT AS x, sum(l_quantity - 25.5::DOUBLE) AS v
  FROM lineitem GROUP BY 1, 2, 3),
fr AS (SELECT DISTINCT frame FROM maps),
dense AS (
  SELECT fr.frame, ys.y::INT AS y, xs.x::INT AS x, coalesce(m.v, 0)::DOUBLE AS v FROM fr CROSS JOIN range(0, 12) ys(y) CROSS JOIN range(0, 10) xs(x)
  LEFT JOIN maps m ON m.frame = fr.frame AND m.y = ys.y AND m.x = xs.x)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, cell, state, normal, f = (quantity / 50, 10 * discount): residual vectors of two components."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        ((F.col("l_suppkey") % 4) * 3 + F.col("l_partkey") % 3).cast("int").alias("cell"),
        F.col("l_returnflag").alias("state"),
        (F.col("l_linestatus") == "F").alias("normal"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("f"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("frame"),
    )


VECTORS = """vectors AS (
  SELECT l_orderkey, l_linenumber, ((l_suppkey % 4) * 3 + l_partkey % 3)::INT AS cell, l_returnflag AS state, l_linestatus = 'F' AS normal,
         l_quantity / 50 AS a, l_discount * 10 AS b, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS frame
  FROM lineitem)"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
