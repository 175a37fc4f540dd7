"""The live path gives what the batch path gives, over several micro-batches and a restart."""

import numpy as np

from quietgrid.operators import temporal as T
from quietgrid.streaming.live import causal_alarms


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(i) % 3, i // 3, float(v)) for i, v in enumerate(rng.normal(size=120))]
    schema = "id long, video int, t int, x double"
    for part in range(4):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {r["id"]: r["s"] for r in T.causal_median(spark.createDataFrame(rows, schema), ["video"], "t", "x", "s").collect()}

    def run(until: str):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        alarms = causal_alarms(stream, "video", "t", "id", "x", 0.8, warm_up=1)
        query = alarms.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    run("first")
    spark.createDataFrame([(500, 0, 40, 9.0), (501, 0, 41, 9.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("after a restart")
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 122
    for i, s in batch.items():
        assert abs(got[i]["smoothed"] - s) < 1e-12 and got[i]["alarm"] == (s > 0.8)
    tail = [x for _, v, _, x in rows if v == 0][-8:] + [9.0]
    assert got[500]["smoothed"] == float(np.median(tail))


def test_stream_meets_a_static_background(spark, tmp_path):
    from pyspark.sql import functions as F

    from quietgrid.operators import background as B
    from quietgrid.streaming.live import alarm_rates, deduplicated, score_stream

    schema = "id long, video int, ts timestamp, f array<double>"
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, i % 2, 100_000 + i, [float(v) for v in rng.normal(size=2)]) for i in range(60)], "id long, video int, s long, f array<double>").select("id", "video", F.timestamp_seconds("s").alias("ts"), "f")
    background = B.finalise(B.moments(rows, ["video"], "f", 2), ["video"], 2)
    rows.unionByName(rows.where("id < 10")).write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", "ts")
    scored = score_stream(stream, background, ["video"], "f", 2)
    query = scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["id"]: r["score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["id"]: r["frx_bayes"] for r in B.detectors(rows, background, ["video"], "f", 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    rates = alarm_rates(rows.withColumn("alarm", F.col("id") % 3 == 0), "ts", "20 seconds").orderBy("start").collect()
    assert [(r["frames"], r["alarms"]) for r in rates] == [(20, 7), (20, 7), (20, 6)]
