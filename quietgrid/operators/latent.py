"""Densities of reduced codes and states of scenes, both under a Dirichlet-process mixture."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dirichlet
from .mixture import Mixture, assign, log_density
from .sampling import cap

#: Code length, weight of a code's position, standard deviation of a uniform position on 0 to 1.
CODE, POSITION, UNIFORM = 16, 2.0, 0.2887


def code_mixture(df: DataFrame, feature: str, ids: list[str], out: str = "bgmm", position: list[str] | None = None, code: int = CODE, most: int = dirichlet.MOST, seed: int = 0, normal: DataFrame | None = None, rows: int | None = None, **options) -> DataFrame:
    """df with the negative log density of each row's code: its first principal components and, given position, where it is.

    position: columns on a scale of 0 to 1, appended with twice the codes' mean sample deviation. The components and the
    mixture are fitted on `normal` (df itself by default), on all of it or on the `rows` first by a hash of seed and ids.
    """
    vectors = lambda d: d.withColumn("_raw", array_to_vector(F.transform(F.col(feature), lambda x: x.cast("double"))))
    learned = vectors(df if normal is None else normal)
    if rows is not None:
        learned = cap(learned, ids, rows, seed)
    pca = PCA(k=code, inputCol="_raw", outputCol="_pc").fit(learned.select("_raw"))
    coded = lambda d: pca.transform(d).withColumn("_code", vector_to_array("_pc")).drop("_raw", "_pc")
    place = []
    if position:
        row = coded(learned).select(*(F.stddev_samp(F.col("_code")[i]).alias(f"s{i}") for i in range(code))).first()
        scale = float(np.mean([v or 0.0 for v in row])) * POSITION / UNIFORM
        place = [(F.col(p) - 0.5) * scale for p in position]
    whole = lambda d: coded(d).withColumn("_code", F.concat("_code", F.array(*place))) if place else coded(d)
    model = dirichlet.fit(whole(learned), "_code", ids, most, seed=seed, **options)
    return log_density(whole(vectors(df)), "_code", model.mixture(), out).drop("_code")


def active(mixture: Mixture, least: float = dirichlet.ACTIVE) -> Mixture:
    """The components of weight over `least`, with weights that sum to 1."""
    own = mixture.w > least
    return Mixture(mixture.w[own] / mixture.w[own].sum(), mixture.mu[own], mixture.cov[own], ridge=0.0)


def scene_states(df: DataFrame, normal: DataFrame, feature: str, ids: list[str], out: str = "state", most: int = 6, seed: int = 0, **options) -> DataFrame:
    """df with the scene state of each frame's descriptor: the most probable component of a mixture of normal ones."""
    return assign(df, feature, active(dirichlet.fit(normal, feature, ids, most, seed=seed, **options).mixture()), out)


def components(mixture: Mixture, spark) -> DataFrame:
    """component, weight, active: the components of a mixture and whether each has weight over 0.01."""
    rows = [(k, float(w), bool(w > dirichlet.ACTIVE)) for k, w in enumerate(mixture.w)]
    return spark.createDataFrame(rows, "component int, weight double, active boolean")
