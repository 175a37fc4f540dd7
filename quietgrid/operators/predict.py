"""Residuals of frames against what earlier frames of the same place predict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .background import moments, precision
from .lookup import lookup


def lagged(df: DataFrame, keys: list[str], order: str, value: str, lags: int, out: str = "_v") -> DataFrame:
    """df with (value 1, 2, ... lags rows before, value) of each series in an array; rows with fewer before them are left out."""
    by = Window.partitionBy(*keys).orderBy(order)
    parts = [F.lag(value, k).over(by) for k in range(1, lags + 1)]
    return df.withColumn(out, F.array(*(p.cast("double") for p in parts), F.col(value).cast("double"))).where(f"{out}[{lags - 1}] is not null")


def autoregression(rows: DataFrame, cell: str, vector: str, lags: int) -> DataFrame:
    """cell, weights, shift: a ridge regression of the last of `lags` + 1 numbers on the others, from each cell's moments alone.

    The ridge is 1e-3 of the predictors' mean variance, plus 1e-8. Moments are sums, so a cell with any number of rows is a row
    for each task in the shuffle.
    """
    sums = moments(rows, [cell], vector, lags + 1)
    schema = T.StructType([rows.schema[cell], T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("shift", T.DoubleType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                n = b["n"].to_numpy(np.float64)[:, None]
                mean = np.array(b["s1"].tolist()) / n
                cov = np.array(b["s2"].tolist()).reshape(len(b), lags + 1, lags + 1) / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
                weights = np.einsum("nij,nj->ni", precision(cov[:, :lags, :lags]), cov[:, :lags, lags])
                yield pd.DataFrame({cell: b[cell], "weights": list(weights), "shift": mean[:, lags] - (weights * mean[:, :lags]).sum(1)})

    return sums.mapInPandas(solve, schema)


def predictive_residual(df: DataFrame, normal: str, keys: list[str], order: str, cell: str, value: str, lags: int = 2, out: str = "residual") -> DataFrame:
    """df with value minus its prediction from the `lags` rows before it, learned for each cell from rows where `normal` holds.

    Rows with fewer rows before them, and those of cells without normal rows, are left out. keys name a series.
    """
    rows = lagged(df, keys, order, value, lags)
    model = autoregression(rows.where(normal), cell, "_v", lags)
    terms = F.aggregate(F.zip_with(F.slice("_v", 1, lags), F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return lookup(rows, model, [cell]).withColumn(out, F.element_at("_v", lags + 1) - F.col("shift") - terms).drop("_v", "weights", "shift")
