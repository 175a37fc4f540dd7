"""Sums of arrays over all rows of a table: a partial sum for each task, added up by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length, without nulls, as rows of a matrix of doubles."""
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(df: DataFrame, columns: list[str], part: Callable[..., np.ndarray]) -> np.ndarray | None:
    """The sum of part(matrix of each column) over all batches of rows; None if there are no rows.

    Arrays are added up in each task and then by position, with map-side combine, so the driver gets one array however many
    rows or tasks there are. part's result must have one shape.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(*(matrix(c) for c in batch.columns))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([list(total.shape)], pa.list_(pa.int32()))], names=["sums", "shape"])

    parts = df.select(*columns).mapInArrow(task, "sums array<double>, shape array<int>")
    rows = parts.select("shape", F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"), F.first("shape").alias("shape")).collect()
    if not rows:
        return None
    out = np.empty(len(rows))
    for r in rows:
        out[r["at"]] = r["value"]
    return out.reshape(rows[0]["shape"])
