"""Judging text records against what normal records show: a lexical stand-in for a language model's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = "[a-z]+"


def _terms(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    return df.select(*ids, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))).alias("term"))


def normal_terms(normal: DataFrame, ids: list[str], text: str, least: int = 2) -> DataFrame:
    """term, n: the words of normal records, with the number of records, from `least` on: the list of normal things."""
    return _terms(normal, ids, text).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def log_odds(records: DataFrame, normal: DataFrame, ids: list[str], text: str, out: str = "score") -> DataFrame:
    """ids, terms, unknown, out: ln((unknown + 1/2) / (known + 1/2)) over a record's distinct words; 0 for none."""
    marked = _terms(records, ids, text).join(normal.select("term", F.lit(1).alias("_known")), "term", "left")
    counted = marked.groupBy(*ids).agg(F.count("*").alias("terms"), F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("unknown"))
    rows = records.select(*ids).join(counted, ids, "left").na.fill(0, ["terms", "unknown"])
    return rows.withColumn(out, F.ln((F.col("unknown") + 0.5) / (F.col("terms") - F.col("unknown") + 0.5)))
