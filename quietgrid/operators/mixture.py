"""Mixture backgrounds: log densities under a mixture, and a universal mixture adapted to each cell."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import lookup
from .sampling import cap

#: Components, relevance of the universal mixture, rows it is fitted on, its regularisation.
COMPONENTS, RELEVANCE, ROWS, REGULARISATION = 5, 16.0, 200_000, 1e-4


class Mixture:
    """weights (K), means (K, C) and covariances (K, C, C) with what log densities need. Its size doesn't grow with data."""

    def __init__(self, weights, means, covs, ridge: float = REGULARISATION):
        self.w, self.mu, self.cov = (np.asarray(a, np.float64) for a in (weights, means, covs))
        self.cov = self.cov + ridge * np.eye(self.cov.shape[-1])
        self.p = np.linalg.inv(self.cov)
        self.ld = np.linalg.slogdet(self.p)[1]

    @classmethod
    def fit(cls, df: DataFrame, feature: str, k: int, seed: int = 0, iterations: int = 50) -> Mixture:
        model = GaussianMixture(k=k, seed=seed, maxIter=iterations, featuresCol="_v").fit(df.select(array_to_vector(F.col(feature)).alias("_v")))
        rows = model.gaussiansDF.select("mean", F.col("cov")).collect()  # k rows
        return cls(model.weights, [r["mean"].toArray() for r in rows], [r["cov"].toArray() for r in rows])

    def log_terms(self, x: np.ndarray, w: np.ndarray | None = None, mu: np.ndarray | None = None) -> np.ndarray:
        """log w_k N(x | mu_k, S_k) as (N, K); w and mu may be given by row."""
        w = np.broadcast_to(self.w, (len(x), len(self.w))) if w is None else w
        quad = distances(x, self.mu if mu is None else np.moveaxis(mu, 1, 0), self.p)
        return np.log(np.maximum(w, 1e-300)) + 0.5 * self.ld - 0.5 * quad - 0.5 * x.shape[1] * math.log(2 * math.pi)


def distances(x: np.ndarray, means: np.ndarray, precisions: np.ndarray) -> np.ndarray:
    """Squared distances (N, K) of rows from K means, (K, C) or by row (K, N, C), a matrix product for each component."""
    out = np.empty((len(x), len(precisions)))
    for k, (mu, p) in enumerate(zip(means, precisions, strict=True)):
        z = x - mu
        out[:, k] = np.einsum("nc,nc->n", z @ p, z)
    return out


def logsumexp(terms: np.ndarray) -> np.ndarray:
    top = terms.max(1, keepdims=True)
    return (top + np.log(np.exp(terms - top).sum(1, keepdims=True)))[:, 0]


def adapt(df: DataFrame, cell: str, feature: str, ubm: Mixture, relevance: float = RELEVANCE) -> DataFrame:
    """cell, w, mu (flattened): weights and means of the universal mixture adapted to each cell's rows."""
    k, c = ubm.mu.shape
    kind = df.schema[cell].dataType

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, own in b.groupby(cell):
                x = np.array(own[feature].tolist(), np.float64)
                terms = ubm.log_terms(x)
                gamma = np.exp(terms - logsumexp(terms)[:, None])
                yield pd.DataFrame({cell: [key], "rows": [len(x)], "n": [gamma.sum(0)], "s": [(gamma.T @ x).ravel()]})

    parts = df.select(cell, feature).mapInPandas(partial, T.StructType([T.StructField(cell, kind), T.StructField("rows", T.LongType()), T.StructField("n", T.ArrayType(T.DoubleType())), T.StructField("s", T.ArrayType(T.DoubleType()))]))

    def total(own: pd.DataFrame) -> pd.DataFrame:
        rows, n, s = own["rows"].sum(), np.sum(own["n"].tolist(), 0), np.sum(own["s"].tolist(), 0).reshape(k, c)
        a = n / (n + relevance)
        w = a * n / rows + (1 - a) * ubm.w
        mu = a[:, None] * s / np.maximum(n, 1e-6)[:, None] + (1 - a)[:, None] * ubm.mu
        return pd.DataFrame({cell: [own[cell].iloc[0]], "w": [w / w.sum()], "mu": [mu.ravel()]})

    # one row for each cell and batch is left to add up
    return parts.groupBy(cell).applyInPandas(total, T.StructType([T.StructField(cell, kind), T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("mu", T.ArrayType(T.DoubleType()))]))


def score(df: DataFrame, adapted: DataFrame, cell: str, feature: str, ubm: Mixture, out: str) -> DataFrame:
    """df with the negative log density of each row under its cell's mixture; rows of unseen cells are left out."""

    @F.pandas_udf(T.DoubleType())
    def density(f: pd.Series, w: pd.Series, mu: pd.Series) -> pd.Series:
        if not len(f):
            return pd.Series([], dtype="float64")
        x = np.array(f.tolist(), np.float64)
        return pd.Series(-logsumexp(ubm.log_terms(x, np.array(w.tolist()), np.array(mu.tolist()).reshape(len(x), *ubm.mu.shape))))

    return lookup(df, adapted, [cell]).withColumn(out, density(feature, "w", "mu")).drop("w", "mu")


def universal_background(df: DataFrame, cell: str, feature: str, ids: list[str], out: str = "ubm", components: int = COMPONENTS, rows: int = ROWS, seed: int = 0) -> DataFrame:
    """Fits the universal mixture on a capped sample, adapts it to every cell over all rows, and scores all rows."""
    ubm = Mixture.fit(cap(df, ids, rows, seed), feature, components, seed)
    return score(df, adapt(df, cell, feature, ubm), cell, feature, ubm, out)


def log_density(df: DataFrame, feature: str, mixture: Mixture, out: str) -> DataFrame:
    """df with the negative log density of each row's vector under a mixture."""

    @F.pandas_udf(T.DoubleType())
    def density(f: pd.Series) -> pd.Series:
        return pd.Series(-logsumexp(mixture.log_terms(np.array(f.tolist(), np.float64))) if len(f) else [], dtype="float64")

    return df.withColumn(out, density(feature))


def assign(df: DataFrame, feature: str, mixture: Mixture, out: str) -> DataFrame:
    """df with the most probable component of each row (the first of equals)."""

    @F.pandas_udf(T.IntegerType())
    def best(f: pd.Series) -> pd.Series:
        return pd.Series(mixture.log_terms(np.array(f.tolist(), np.float64)).argmax(1) if len(f) else [], dtype="int32")

    return df.withColumn(out, best(feature))
