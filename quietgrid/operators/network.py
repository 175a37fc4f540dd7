"""Features from a frozen network: a hook for any function of a batch of frames or vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_features(df: DataFrame, column: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "f", shape: list[int] | None = None, batch: int = 64) -> DataFrame:
    """df with an array<double> that a network gives for each row's numbers (an array column without nulls).

    load() is called once in each Python worker and returns a function from a batch (rows, *shape) to (rows, length): a session
    of a model file, or any function. What it returns must be the same for a row whatever rows share its batch.
    """

    def make():
        network = load()
        return lambda x: np.asarray(network(x), np.float64)

    predict = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[shape] if shape else None)
    return df.withColumn(out, predict(F.col(column).cast("array<double>")))


def pixels(px: str = "px") -> Column:
    """A frame's bytes as an array of numbers from -1 to 1, in SQL functions."""
    raw = F.hex(px)
    at = F.sequence(F.lit(0), F.octet_length(px) - 1)
    level = F.transform(at, lambda i: F.conv(F.substr(raw, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)
    return F.when(F.octet_length(px) == 0, F.array().cast("array<double>")).otherwise(level)
