"""The feature cache computes what is missing or stale, and scores are read by detector."""

from pyspark.sql import functions as F

from quietgrid.sources import sinks, store


def test_feature_cache(spark, tmp_path):
    done = []

    def compute(rows):
        done.append(sorted(r["video"] for r in rows.select("video").collect()))
        return rows.select("video", F.length("px").alias("size"))

    def run(rows):
        df = spark.createDataFrame(rows, "video string, px string")
        return sorted((r["video"], r["size"]) for r in store.refresh_features(df, str(tmp_path / "cache"), ["video"], "px", compute, "size").collect())

    assert run([("a", "x"), ("b", "yy")]) == [("a", 1), ("b", 2)]
    assert run([("a", "x"), ("b", "zzz"), ("c", "")]) == [("a", 1), ("b", 3), ("c", 0)]
    assert run([("b", "zzz")]) == [("b", 3)]
    assert done == [["a", "b"], ["b", "c"], []]


def test_scores_by_detector(spark, tmp_path):
    rows = spark.createDataFrame([("s", d, "v", t, 1.0) for d in ("frx_cell", "frx_bayes", "rem") for t in range(2)], "scene string, det string, video string, t int, score double")
    sinks.write_partitioned(rows, str(tmp_path / "scores"), ["det"])
    assert store.read_scores(spark, str(tmp_path / "scores"), prefix="frx").count() == 4
    assert {r["det"] for r in store.read_scores(spark, str(tmp_path / "scores"), ["rem"]).collect()} == {"rem"}
