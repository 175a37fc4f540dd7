"""Features by batch functions, unreadable images, score and map tables, first frames."""

import numpy as np
from pyspark.sql import functions as F

from quietgrid.functions import scalar as S
from quietgrid.operators.network import batch_features, pixels
from quietgrid.operators.sampling import first_frames
from quietgrid.sources import frames as R
from quietgrid.sources.sinks import write_partitioned
from quietgrid.sources.store import read_scores


def test_a_function_of_batches(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (9, 6), dtype=np.uint8)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id int, px binary").repartition(2)
    weights = rng.normal(size=(6, 3))
    rows = batch_features(df.withColumn("v", pixels()), "v", lambda: lambda b: np.tanh(b.reshape(len(b), 6) @ weights), shape=[2, 3], batch=4).collect()
    for r in rows:
        np.testing.assert_allclose(r["f"], np.tanh((x[r["id"]] / 127.5 - 1) @ weights), atol=1e-12)
    assert spark.createDataFrame([(bytearray(),)], "px binary").select(pixels()).first()[0] == []


def test_unreadable_images_repeat_the_last_readable(spark, tmp_path):
    def pgm(v):
        return b"P5 2 1 255\n" + bytes([v, v])

    for video, contents in (("a", [b"?", pgm(1), b"broken", b"broken", pgm(2)]), ("b", [b"no"])):
        (tmp_path / video).mkdir()
        for i, c in enumerate(contents):
            (tmp_path / video / f"{i}.pgm").write_bytes(c)
    rows = R.read_images(spark, str(tmp_path / "*" / "*.pgm"), r"([^/]+)/[^/]+\.pgm$", ["video"], R.decode_pgm).orderBy("video", "t").collect()
    assert [(r["video"], r["t"], None if r["px"] is None else r["px"][0], r["w"]) for r in rows] == [("a", 0, None, None), ("a", 1, 1, 2), ("a", 2, 1, 2), ("a", 3, 1, 2), ("a", 4, 2, 2), ("b", 0, None, None)]


def test_score_and_map_tables_come_back(spark, tmp_path):
    scores = [("s", d, "v", t, 0.5 * t) for d in ("rem", "frx_cell", "frx_bayes") for t in range(3)]
    write_partitioned(spark.createDataFrame(scores, "scene string, det string, video string, t int, score double"), str(tmp_path / "scores"), ["det"])
    for options, want in (({}, scores), ({"detectors": ["rem"]}, scores[:3]), ({"prefix": "frx"}, scores[3:])):
        got = read_scores(spark, str(tmp_path / "scores"), **options).select("scene", "det", "video", "t", "score").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    maps = [("rem", "v", t, c, float(t + c), c % 2 == 0) for t in range(2) for c in range(4)]
    write_partitioned(spark.createDataFrame(maps, "det string, video string, t int, cell_id int, v double, is_ref boolean"), str(tmp_path / "maps"), ["det"])
    assert sorted((r["det"], r["video"], r["t"], r["cell_id"], r["v"], r["is_ref"]) for r in spark.read.parquet(str(tmp_path / "maps")).collect()) == maps


def test_first_frames_and_alarm_lines(spark):
    df = spark.createDataFrame([(v, t) for v in "ab" for t in range(v == "a" and 5 or 1)], "video string, t int")
    assert sorted(tuple(r) for r in first_frames(df, ["video"], "t", 2).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    row = spark.sql("SELECT timestamp'2020-01-02 03:04:05' AS ts, 7 AS t, 3.0D AS s").select(S.alarm_line(F.col("ts"), F.col("t"), F.col("s"), 2.0)).first()[0]
    assert row == "[03:04:05] frame 7: ALARM score/thr=1.50"
