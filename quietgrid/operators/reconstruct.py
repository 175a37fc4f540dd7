"""A pluggable reconstructor of patches, and a linear one: principal components learned from normal patches.

Anything with fit(df) and residuals(df) can replace it; autoencoder.py has a trained one that isn't linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sums import summed


class LinearReconstructor:
    """x is rebuilt from its first components around the mean. Fitted from moments, so one pass over any number of rows."""

    def __init__(self, components: int):
        self.components, self.mean, self.axes, self.spread = components, None, None, None

    def fit(self, df: DataFrame, feature: str, dim: int) -> LinearReconstructor:
        """Takes all rows' vectors, arrays of `dim` numbers; without rows the mean is zero and the components the axes."""
        sums = summed(df, [feature], lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
        self.mean, cov = np.zeros(dim), np.eye(dim)
        if sums is not None:
            self.mean = sums[1 : 1 + dim] / sums[0]
            cov = sums[1 + dim :].reshape(dim, dim) / sums[0] - np.outer(self.mean, self.mean)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][: self.components]
        self.axes, self.spread = vectors[:, order], values[order]
        return self

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        return self.mean + (x - self.mean) @ self.axes @ self.axes.T

    def residuals(self, df: DataFrame, feature: str, out: str) -> DataFrame:
        """df with x minus its reconstruction."""
        rebuild = self.rebuild

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def residual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                a = np.array(x.tolist(), np.float64)
                yield pd.Series(list(a - rebuild(a)) if len(a) else [], dtype=object)

        return df.withColumn(out, residual(feature))


def overlap_residual(patches: DataFrame, residual: str, frames: list[str], height: int, width: int, patch: int) -> DataFrame:
    """frames, y, x, r: the mean at each pixel of the residuals of the patches (frames, py, px) that cover it."""
    rows = patches.select(*frames, "py", "px", F.posexplode(residual).alias("_i", "_r"))
    rows = rows.select(*frames, (F.col("py") + F.floor(F.col("_i") / patch)).cast("int").alias("y"), (F.col("px") + F.col("_i") % patch).cast("int").alias("x"), "_r")
    return rows.where((F.col("y") < height) & (F.col("x") < width)).groupBy(*frames, "y", "x").agg(F.avg("_r").alias("r"))
