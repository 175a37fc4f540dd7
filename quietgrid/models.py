"""Fitted backgrounds as pyspark.ml models: an Estimator learns tables of parameters, its Model scores rows and can be saved.

    model = BackgroundEstimator(cellCol="cell", featuresCol="f", dim=2).fit(normal)
    model.write().overwrite().save(path)
    BackgroundModel.load(path).transform(stream_or_table)

A saved model is a folder of metadata and a Parquet table for each of its tables, so one session learns and another scores.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from .operators import background as B
from .operators import dirichlet, mixture, skew
from .operators.autoencoder import Autoencoder
from .session import checkpointed


class _Settings(Params):
    """What estimators and models are told: columns, vector length and sizes."""

    cellCol = Param(Params._dummy(), "cellCol", "column of the cell", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "column of the vector, array<double>", TypeConverters.toString)
    idCols = Param(Params._dummy(), "idCols", "columns that name a row, by which samples are drawn", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the result", TypeConverters.toString)
    dim = Param(Params._dummy(), "dim", "length of the vectors", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "components, at most where they can be fewer", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds or steps, at most where they can be fewer", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of what is drawn", TypeConverters.toInt)

    def of(self, name: str):
        return self.getOrDefault(name)


class _Writer(MLWriter):
    def __init__(self, model: _TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"tables": sorted(self.model.tables)})
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type[_TableModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _TableModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        if not found["class"].endswith(f".{self.cls.__name__}"):
            raise ValueError(f"{path} holds a {found['class']}")
        model = self.cls({n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in found["tables"]})
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model


class _TableModel(Model, _Settings, MLWritable, MLReadable):
    """A model whose parameters are tables by name, small beside the rows that it was learned from."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = tables or {}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _TableEstimator(Estimator, _Settings):
    """Learns a model's tables; those are written to the shared folder, so that every use of the model reads and none learns again."""

    model: type[_TableModel]
    defaults: dict = {}

    def _begin(self, settings: dict) -> None:
        self._setDefault(seed=0, **self.defaults)
        self._set(**settings)

    def learn(self, rows: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> _TableModel:
        model = self.model({n: checkpointed(t) for n, t in self.learn(dataset).items()})
        return self._copyValues(model)


class BackgroundModel(_TableModel):
    """Adds rem, frx_global, frx_cell and frx_bayes; rows of cells that weren't learned are left out."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return B.detectors(dataset, self.tables["background"], [self.of("cellCol")], self.of("featuresCol"), self.of("dim"))


class BackgroundEstimator(_TableEstimator):
    """Moments of each cell, shrunk towards the scene's."""

    model = BackgroundModel

    @keyword_only
    def __init__(self, *, cellCol: str = "cell", featuresCol: str = "f", dim: int = 1):
        super().__init__()
        self._begin(self._input_kwargs)
        self._setDefault(cellCol="cell", featuresCol="f", dim=1)

    def learn(self, rows: DataFrame) -> dict[str, DataFrame]:
        cell, dim = self.of("cellCol"), self.of("dim")
        return {"background": B.finalise(B.moments(rows, [cell], self.of("featuresCol"), dim), [cell], dim)}


def _mixture_table(m: mixture.Mixture, spark) -> DataFrame:
    rows = [(k, float(w), mu.tolist(), cov.ravel().tolist()) for k, (w, mu, cov) in enumerate(zip(m.w, m.mu, m.cov, strict=True))]
    return spark.createDataFrame(rows, "component int, w double, mu array<double>, cov array<double>")


def _mixture(table: DataFrame) -> mixture.Mixture:
    rows = table.orderBy("component").collect()  # a row for each component
    d = len(rows[0]["mu"])
    return mixture.Mixture([r["w"] for r in rows], [r["mu"] for r in rows], [np.reshape(r["cov"], (d, d)) for r in rows], ridge=0.0)


class UniversalMixtureModel(_TableModel):
    """Adds the negative log density of a row under its cell's mixture; rows of cells that weren't learned are left out."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return mixture.score(dataset, self.tables["cells"], self.of("cellCol"), self.of("featuresCol"), _mixture(self.tables["components"]), self.of("outputCol"))


class UniversalMixtureEstimator(_TableEstimator):
    """A mixture of a sample of rows, adapted to each cell over all rows."""

    model = UniversalMixtureModel

    @keyword_only
    def __init__(self, *, cellCol: str = "cell", featuresCol: str = "f", idCols: list[str], outputCol: str = "ubm", components: int = mixture.COMPONENTS, seed: int = 0):
        super().__init__()
        self._begin(self._input_kwargs)
        self._setDefault(cellCol="cell", featuresCol="f", outputCol="ubm", components=mixture.COMPONENTS)

    def learn(self, rows: DataFrame) -> dict[str, DataFrame]:
        cell, f, seed = self.of("cellCol"), self.of("featuresCol"), self.of("seed")
        ubm = mixture.Mixture.fit(mixture.cap(rows, self.of("idCols"), mixture.ROWS, seed), f, self.of("components"), seed)
        return {"components": _mixture_table(ubm, rows.sparkSession), "cells": mixture.adapt(rows, cell, f, ubm)}


class DirichletMixtureModel(_TableModel):
    """Adds the negative log density of a row."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return mixture.log_density(dataset, self.of("featuresCol"), _mixture(self.tables["components"]), self.of("outputCol"))


class DirichletMixtureEstimator(_TableEstimator):
    """A mixture with a Dirichlet-process prior over all rows."""

    model = DirichletMixtureModel

    @keyword_only
    def __init__(self, *, featuresCol: str = "f", idCols: list[str], outputCol: str = "density", components: int = dirichlet.MOST, rounds: int = dirichlet.ROUNDS, seed: int = 0):
        super().__init__()
        self._begin(self._input_kwargs)
        self._setDefault(featuresCol="f", outputCol="density", components=dirichlet.MOST, rounds=dirichlet.ROUNDS)

    def learn(self, rows: DataFrame) -> dict[str, DataFrame]:
        found = dirichlet.fit(rows, self.of("featuresCol"), self.of("idCols"), self.of("components"), self.of("rounds"), seed=self.of("seed"))
        return {"components": _mixture_table(found.mixture(), rows.sparkSession)}


class SkewedBackgroundModel(_TableModel):
    """Adds the negative log density of a row under its cell's skewed t; rows of cells that weren't learned are left out."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return skew.skewed_scores(dataset, self.tables["cells"], self.of("cellCol"), self.of("featuresCol"), self.of("outputCol"))


class SkewedBackgroundEstimator(_TableEstimator):
    """A skewed t for each cell, drawn half-way towards the scene's. Both take all rows, so idCols and seed don't matter."""

    model = SkewedBackgroundModel

    @keyword_only
    def __init__(self, *, cellCol: str = "cell", featuresCol: str = "f", idCols: list[str], outputCol: str = "skew_t", rounds: int = skew.ROUNDS, seed: int = 0):
        super().__init__()
        self._begin(self._input_kwargs)
        self._setDefault(cellCol="cell", featuresCol="f", outputCol="skew_t", rounds=skew.ROUNDS)

    def learn(self, rows: DataFrame) -> dict[str, DataFrame]:
        return {"cells": skew.skewed_fits(rows, self.of("cellCol"), self.of("featuresCol"), rounds=self.of("rounds"))}


class ReconstructorModel(_TableModel):
    """Adds what the network doesn't rebuild of a row."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        network = Autoencoder(self.of("components"))
        network.parameters = {r["name"]: np.reshape(r["numbers"], r["shape"]) for r in self.tables["parameters"].collect()}  # five rows
        return network.residuals(dataset, self.of("featuresCol"), self.of("outputCol"))


class ReconstructorEstimator(_TableEstimator):
    """A network of tanh units, trained on all rows."""

    model = ReconstructorModel

    @keyword_only
    def __init__(self, *, featuresCol: str = "f", idCols: list[str], outputCol: str = "residual", dim: int, components: int, rounds: int = 40, seed: int = 0):
        super().__init__()
        self._begin(self._input_kwargs)
        self._setDefault(featuresCol="f", outputCol="residual", rounds=40)

    def learn(self, rows: DataFrame) -> dict[str, DataFrame]:
        network = Autoencoder(self.of("components"), self.of("rounds"), seed=self.of("seed")).fit(rows, self.of("featuresCol"), self.of("dim"), self.of("idCols"))
        table = [(n, list(np.shape(v)), np.ravel(v).tolist()) for n, v in network.parameters.items()]
        return {"parameters": rows.sparkSession.createDataFrame(table, "name string, shape array<int>, numbers array<double>")}
