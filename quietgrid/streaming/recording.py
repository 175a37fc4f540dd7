"""Sinks that a restart can't make wrong: every micro-batch has a folder of its own, which a repeat of it replaces."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

_BATCH = "_batch"


def _paths(spark: SparkSession, path: str) -> tuple:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> dict[int, str]:
    """{batch: folder} of the micro-batches whose write has ended."""
    root, fs = _paths(spark, path)
    if not fs.exists(root):
        return {}
    found = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{_BATCH}=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(name.split("=")[1])] = f"{path}/{name}"
    return found


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that finished micro-batches have written, without the batch's number; no rows if there are none."""
    folders = list(_finished(spark, path).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def batch_writer(path: str, pick: Callable[[DataFrame, int], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes a micro-batch, or what pick(rows, batch) leaves of it, to its own folder."""

    def write(rows: DataFrame, batch: int) -> None:
        (pick(rows, batch) if pick else rows).write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch}")

    return write


def write_alarms(alarms: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer, to be started, of the rows whose alarm is true; read_batches() reads them, each once whatever restarts there were."""
    return alarms.writeStream.foreachBatch(batch_writer(path, lambda rows, _: rows.where("alarm"))).option("checkpointLocation", checkpoint)


def record(stream: DataFrame, path: str, limit: int, order: list[str], checkpoint: str, **trigger) -> int:
    """Records a stream's first `limit` rows, then stops the query; returns how many rows there are.

    Of the micro-batch that reaches the limit the first rows by `order` are taken, by a distributed top-k. A recording that
    was stopped or killed goes on where it was: what finished micro-batches hold counts, the others are written again.
    trigger is as in DataStreamWriter.trigger(); with availableNow it also ends when the source is exhausted.
    """
    spark, full = stream.sparkSession, threading.Event()
    schema = stream.schema

    def held(batch: int | None = None) -> int:
        folders = [p for b, p in _finished(spark, path).items() if batch is None or b < batch]
        return spark.read.schema(schema).parquet(*folders).count() if folders else 0

    def write(rows: DataFrame, batch: int) -> None:
        room = limit - held(batch)
        if room > 0:
            batch_writer(path)(rows.orderBy(*order).limit(room), batch)
        if held() >= limit:
            full.set()

    if held() < limit:
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        query: StreamingQuery = (writer.trigger(**trigger) if trigger else writer).start()
        while not full.wait(0.1) and query.isActive:
            pass
        if full.is_set():
            query.stop()
        query.awaitTermination()
    return held()


