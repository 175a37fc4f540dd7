"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import background as B
from ..session import folder
from ..streaming.buffer import live_clips
from ..streaming.live import alarm_rates, calibrated_threshold, causal_alarms, deduplicated, score_stream
from ..streaming.recording import read_batches, record, write_alarms
from .bindings import FRAMES, rounded, table
from .register import query

QUANTILE, RECORDED = 0.995, 500


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The events table as a batch and as a stream of files, with camera, cell and feature."""
    feature = lambda df: df.select("event_id", F.col("user_id").alias("video"), "ts", "event_type", (F.col("user_id") % 10).cast("int").alias("cell"), F.array(F.log1p("value")).alias("f"))
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    return feature(batch), feature(stream)


def _run(stream: DataFrame) -> DataFrame:
    """Writes the stream until its source is exhausted; state and output are in the shared folder."""
    root = folder(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


_LIVE = f"""{FRAMES}, s AS (SELECT *, (video % 10)::INT AS cell FROM frames), g AS (SELECT avg(x) AS gm, var_pop(x) AS gv FROM s WHERE y = 0),
c AS (SELECT cell, avg(x) AS m, var_pop(x) AS v FROM s WHERE y = 0 GROUP BY 1),
b AS (SELECT cell, (m + gm) / 2 AS m, (v + gv) / 2 + (m - gm) * (m - gm) / 4 AS v FROM c CROSS JOIN g),
d AS (SELECT s.*, (x - m) * (x - m) / (v * (1 + 1e-3) + 1e-8) AS d FROM s JOIN b USING (cell)),
n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t) - 1 AS turn FROM d WHERE y = 0),
k AS (SELECT median(d) OVER (PARTITION BY video ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS sm FROM n WHERE turn % 2 = 0),
cut AS (SELECT quantile_cont(sm, {QUANTILE}) AS cut FROM k),
f AS (SELECT *, median(d) OVER (PARTITION BY video ORDER BY t ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS sm FROM d)"""


def _alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static background and the threshold that its normal scores give, then the scored stream and causal medians from bounded state, after three frames."""
    batch, stream = _events(spark, sf_dir)
    normal = batch.where("event_type <> 'error'")
    background = B.finalise(B.moments(normal, ["cell"], "f", 1), ["cell"], 1)
    cut = calibrated_threshold(score_stream(normal, background, ["cell"], "f", 1), "video", "ts", "event_id", "score", QUANTILE)
    scored = score_stream(stream.drop("event_type"), background, ["cell"], "f", 1)
    return causal_alarms(scored, "video", "ts", "event_id", "score", cut, warm_up=4)


@query(f"WITH {_LIVE} SELECT event_id, video, round(d, 6) AS score, round(sm, 6) AS smoothed, sm > cut AS alarm FROM f CROSS JOIN cut WHERE t >= 3")
def stream_alarms(spark, sf_dir):
    """The live path, its threshold the 0.995 quantile of calibration scores."""
    return rounded(_run(_alarms(spark, sf_dir)).select("event_id", "video", "score", "smoothed", "alarm"), "score", "smoothed")


@query(f"WITH {_LIVE} SELECT event_id, video, round(sm, 6) AS smoothed FROM f CROSS JOIN cut WHERE t >= 3 AND sm > cut")
def alarm_sink(spark, sf_dir):
    """The alarms alone, through a sink that a restart can't make wrong."""
    root = folder(spark, "alarms")
    alarms = _alarms(spark, sf_dir)
    write_alarms(alarms, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    kinds = ", ".join(f"{n} {k}" for n, k in alarms.dtypes)
    return rounded(read_batches(spark, f"{root}/out", kinds).select("event_id", "video", "smoothed"), "smoothed")


@query(f"""WITH {FRAMES} SELECT event_id, video, {", ".join(f"round(lag(x, {2 * (3 - k)}) OVER w, 6) AS c{k}" for k in range(4))}
FROM frames WINDOW w AS (PARTITION BY video ORDER BY t) QUALIFY t >= 6""")
def stream_clips(spark, sf_dir):
    """Clips of four frames, two apart, from a ring of frames in the state store."""
    _, stream = _events(spark, sf_dir)
    rows = _run(live_clips(stream.withColumn("x", F.col("f")[0]), "video", "event_id", "ts", "x"))
    return rounded(rows.select("event_id", "video", *(F.col("clip")[k].alias(f"c{k}") for k in range(4))), *(f"c{k}" for k in range(4)))


@query(f"SELECT event_id, user_id AS video, round(ln(1 + value), 6) AS x FROM events ORDER BY ts, event_id LIMIT {RECORDED}")
def bounded_recording(spark, sf_dir):
    """The first frames of a stream, recorded until there are enough: the bound is the feature."""
    _, stream = _events(spark, sf_dir)
    root = folder(spark, "recording")
    stream = stream.select("event_id", "video", "ts", F.col("f")[0].alias("x"))
    record(stream, f"{root}/out", RECORDED, ["ts", "event_id"], f"{root}/state", availableNow=True)
    kinds = ", ".join(f"{n} {k}" for n, k in stream.dtypes)
    return rounded(read_batches(spark, f"{root}/out", kinds).select("event_id", "video", "x"), "x")


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS frames, count(*) FILTER (event_type = 'error') AS alarms FROM d GROUP BY d.day
HAVING d.day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_rates(spark, sf_dir):
    """Daily frames and errors of a stream in which every row comes twice: repeats within the watermark are dropped, and a day is told when it is over."""
    twice = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = twice.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("alarm"))
    out = _run(alarm_rates(deduplicated(rows, "event_id", "ts"), "ts", delay=None))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "frames", "alarms")
