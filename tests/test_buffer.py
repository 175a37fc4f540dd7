"""Clips, recordings and alarms of streams, over several micro-batches, restarts and kills."""

import numpy as np
import pytest

from quietgrid.operators import temporal as T
from quietgrid.streaming.buffer import live_clips
from quietgrid.streaming.live import calibrated_threshold, causal_alarms
from quietgrid.streaming.recording import batch_writer, read_batches, record, write_alarms

SCHEMA = "id long, video int, t int, x array<double>"


def write(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def rows(n=120, first=0):
    rng = np.random.default_rng(first)
    return [(first + i, i % 3, (first + i) // 3, rng.normal(size=2).tolist()) for i in range(n)]


def test_clips_equal_batch_over_restarts(spark, tmp_path):
    every = rows(90) + rows(30, 90)
    for part in range(3):
        write(spark, tmp_path / "in", every[part * 30 : part * 30 + 30])

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live_clips(stream, "video", "id", "t", "x").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run()
    write(spark, tmp_path / "in", every[90:])
    run()
    whole = spark.createDataFrame(every, SCHEMA)
    batch = {r["id"]: r["clip"] for r in T.clips(whole, ["video"], "t", "x", "clip").where("t >= 6").collect()}
    live = {r["id"]: r["clip"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(batch) == 120 - 18 and live == batch


def test_clips_of_numbers_and_of_one_frame(spark, tmp_path):
    schema = "id long, video int, t int, x double"
    write(spark, tmp_path / "in", [(i, 0, i, float(i)) for i in range(5)], schema)
    for length, step, want in ((1, 1, {i: [float(i)] for i in range(5)}), (2, 3, {3: [0.0, 3.0], 4: [1.0, 4.0]}), (9, 9, {})):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = tmp_path / f"out{length}"
        live_clips(stream, "video", "id", "t", "x", "c", length, step).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"state{length}")).trigger(availableNow=True).start().awaitTermination()
        assert {r["id"]: r["c"] for r in spark.read.schema("id long, c array<double>").parquet(str(out)).collect()} == want


def feed(spark, tmp_path, files=6):
    for part in range(files):
        write(spark, tmp_path / "in", rows(20, part * 20))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_recording_stops_at_its_limit(spark, tmp_path):
    stream = feed(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert record(stream, out, 50, ["t", "id"], state, availableNow=True) == 50
    assert record(stream, out, 50, ["t", "id"], state, availableNow=True) == 50
    got = sorted(r["id"] for r in read_batches(spark, out, SCHEMA).collect())
    assert len(set(got)) == 50 and set(range(40)) <= set(got)  # files come in order; of the third the first ten
    assert record(stream, out, 70, ["t", "id"], state, availableNow=True) >= 50


def test_a_killed_recording_goes_on(spark, tmp_path, monkeypatch):
    """Killed after a micro-batch is written and before it is committed: it is written again, not twice."""
    from quietgrid.streaming import recording

    stream = feed(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    whole, calls = recording.batch_writer, []

    def dying(path, pick=None):
        def write_then_die(df, batch):
            whole(path, pick)(df, batch)
            calls.append(batch)
            if len(calls) == 2:
                raise RuntimeError("killed")

        return write_then_die

    monkeypatch.setattr(recording, "batch_writer", dying)
    with pytest.raises(Exception, match="killed"):
        record(stream, out, 75, ["t", "id"], state, availableNow=True)
    assert read_batches(spark, out, SCHEMA).count() == 40
    monkeypatch.setattr(recording, "batch_writer", whole)
    assert record(stream, out, 75, ["t", "id"], state, availableNow=True) == 75
    got = [r["id"] for r in read_batches(spark, out, SCHEMA).collect()]
    assert len(got) == len(set(got)) == 75 and calls == [0, 1]


def test_a_half_written_batch_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    batch_writer(out)(spark.createDataFrame(rows(5), SCHEMA), 0)
    batch_writer(out)(spark.createDataFrame(rows(5, 5), SCHEMA), 1)
    (tmp_path / "out" / "_batch=1" / "_SUCCESS").unlink()
    assert read_batches(spark, out, SCHEMA).count() == 5
    assert read_batches(spark, str(tmp_path / "nowhere"), SCHEMA).count() == 0


def test_alarms_come_once(spark, tmp_path):
    schema = "id long, video int, t int, x double"
    rng = np.random.default_rng(2)
    values = rng.normal(size=80).tolist()
    for part in range(4):
        write(spark, tmp_path / "in", [(i, i % 2, i // 2, values[i]) for i in range(part * 20, part * 20 + 20)], schema)
    whole = spark.createDataFrame([(i, i % 2, i // 2, v) for i, v in enumerate(values)], schema)
    cut = calibrated_threshold(whole, "video", "t", "id", "x", 0.8)
    smoothed = []
    for video in range(2):
        s = values[video::2][::2]
        smoothed += [float(np.median(s[max(0, i - 3) : i + 1])) for i in range(len(s))]
    assert cut == pytest.approx(np.quantile(smoothed, 0.8))
    assert calibrated_threshold(whole.where("false"), "video", "t", "id", "x") == float("inf")
    for _ in range(2):  # a second start finds nothing to do
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        alarms = causal_alarms(stream, "video", "t", "id", "x", cut)
        write_alarms(alarms, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["id"] for r in read_batches(spark, str(tmp_path / "out"), "id long, alarm boolean").collect())
    want = {r["id"] for r in T.causal_median(whole, ["video"], "t", "x", "s").where(f"s > {cut}").collect()}
    assert len(got) == len(set(got)) and set(got) == want and want
