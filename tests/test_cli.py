import os

import pytest

from quietgrid.__main__ import main
from quietgrid.plans import registry


def test_list(capsys):
    main(["list"])
    assert capsys.readouterr().out.split() == sorted(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_run(spark, capsys, tmp_path):
    main(["run", "auc_micro", "--data", "/root/testdata/sf0.001"])
    assert "| n | auc |" in capsys.readouterr().out
    main(["run", "label_tallies", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_fit_watch_and_evaluate(spark, tmp_path, capsys):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, i % 2, i // 2, i % 2, [float(v)]) for i, v in enumerate(rng.normal(size=200))]
    schema = "id long, video int, t int, cell int, f array<double>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "normal"))
    odd = [(i, v, t, c, [9.0] if 40 <= t < 60 and v == 0 else f) for i, v, t, c, f in rows]
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "live"))
    main(["fit", "--rows", str(tmp_path / "normal"), "--model", str(tmp_path / "model"), "--dim", "1"])
    main(["watch", "--rows", str(tmp_path / "live"), "--model", str(tmp_path / "model"), "--calibration", str(tmp_path / "normal"), "--out", str(tmp_path / "alarms"), "--detector", "frx_bayes"])
    found = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "alarms")).collect()
    assert {r["t"] for r in found if r["video"] == 0} >= set(range(45, 60)) and len(found) < 30 and f"{len(found)} alarms" in capsys.readouterr().out
    spark.createDataFrame([("good", 0, t, float(t)) for t in range(10)] + [("bad", 0, t, float(-t)) for t in range(10)], "det string, video int, t int, score double").write.parquet(str(tmp_path / "scores"))
    spark.createDataFrame([(0, t, int(t > 6)) for t in range(9)], "video int, t int, y int").write.parquet(str(tmp_path / "labels"))
    main(["evaluate", "--scores", str(tmp_path / "scores"), "--labels", str(tmp_path / "labels")])
    shown = capsys.readouterr().out
    assert "| good | 9 | 1.0 | 0.0 |" in shown and "| bad | 9 | 0.0 |" in shown


def test_record(spark, tmp_path, capsys):
    from quietgrid.sources.cache import write_cache
    from quietgrid.sources.frames import FRAMES

    write_cache(spark.createDataFrame([("s", "test", "v", t, 1, 2, 1, bytearray([t, t])) for t in range(12)], FRAMES), str(tmp_path / "cache"))
    main(["record", "--cache", str(tmp_path / "cache"), "--out", str(tmp_path / "out"), "--frames", "5", "--every", "2"])
    assert "5 frames" in capsys.readouterr().out
    assert sorted(r["t"] for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]
