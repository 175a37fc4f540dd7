"""Joins with parameter tables: which side is broadcast, and what happens beyond the limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgrid.operators import background as B
from quietgrid.operators.lookup import lookup
from quietgrid.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, n=300):
    rows = spark.createDataFrame([(i, i % 3 if i % 2 else 0, None if i % 50 == 0 else 1) for i in range(n)], "id long, k int, z int")
    return rows, spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (7, [5.0, 6.0])], "k int, p array<double>")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways_give_the_same_rows(spark, how):
    rows, table = tables(spark)
    small, large = lookup(rows, table, ["k"], how), lookup(rows, table, ["k"], how, limit=10, salts=4)
    want = sorted(map(str, rows.join(table, "k", how).select("id", "k", "z", "p").collect()))
    for df in (small, large):
        assert sorted(map(str, df.select("id", "k", "z", "p").collect())) == want
    side = "BuildRight" if how == "inner" else "LeftOuter, BuildRight"
    assert "BroadcastHashJoin" in plan(small) and side in plan(small)
    assert "SortMergeJoin" in plan(large) and "Broadcast" not in plan(large)


def test_a_hot_key_goes_to_several_tasks(spark):
    rows = spark.range(4000).withColumn("k", F.lit(1))
    table = spark.createDataFrame([(1, 2.0)], "k int, p double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = lookup(rows, table, ["k"], limit=0, salts=16).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) > 6 and max(r["count"] for r in parts) < 1500


@pytest.mark.parametrize("name", ["residual_detectors", "alarm_scores", "state_conditioned"])
def test_backgrounds_are_what_is_broadcast(spark, name):
    df = QUERIES[name](spark, DATA)
    assert "BuildRight" in plan(df) and "BuildLeft" not in plan(df)


@pytest.mark.parametrize("weighted", [False, True])
def test_moments_of_long_vectors(spark, weighted, monkeypatch):
    """In one task or many, flushed or not, with and without keys: NumPy's."""
    rng = np.random.default_rng(0)
    x, k, w = rng.normal(size=(90, 8)), rng.integers(0, 3, 90), rng.uniform(0.5, 2, 90)
    df = spark.createDataFrame([(int(a), v.tolist(), float(b)) for a, v, b in zip(k, x, w, strict=True)], "k int, f array<double>, w double").repartition(5)
    u = w if weighted else np.ones(90)
    for keys in (["k"], []):
        for r in B.moments(df, keys, "f", 8, "w" if weighted else None).collect():
            own = k == r["k"] if keys else slice(None)
            np.testing.assert_allclose(r["n"], u[own].sum())
            np.testing.assert_allclose(r["s1"], u[own] @ x[own])
            np.testing.assert_allclose(np.reshape(r["s2"], (8, 8)), (x[own] * u[own][:, None]).T @ x[own])
