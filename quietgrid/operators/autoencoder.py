"""A non-linear reconstructor, trained over all rows: each step sums gradients in the tasks and moves a few parameters on the driver.

The network has one hidden layer of tanh units. It begins as the linear reconstructor, whose components it takes over, and is
trained on the mean absolute error and, if asked, against a discriminator that tells rows from reconstructions. Parameters are
arrays of fixed shapes, so neither they nor the gradients grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept
from .reconstruct import LinearReconstructor
from .sums import summed

#: Weight of the error beside the discriminator's loss, decay rates of Adam's two means.
WEIGHT, DECAY = 10.0, (0.5, 0.999)

Parameters = dict[str, np.ndarray]


def forward(p: Parameters, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden units, reconstructions) of rows."""
    h = np.tanh((x - p["mean"]) @ p["w1"] + p["b1"])
    return h, p["mean"] + h @ p["w2"] + p["b2"]


def logits(q: Parameters, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden units, log-odds of being a row and not a reconstruction)."""
    h = np.tanh(x @ q["v"] + q["c"])
    return h, h @ q["u"] + q["e"]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _backward(q: Parameters, x: np.ndarray, h: np.ndarray, slope: np.ndarray) -> tuple[Parameters, np.ndarray]:
    """Gradients of sum(slope * logits) by the discriminator's parameters and by the rows."""
    inner = slope[:, None] * q["u"] * (1 - h * h)
    return {"v": x.T @ inner, "c": inner.sum(0), "u": h.T @ slope, "e": slope.sum(keepdims=True)}, inner @ q["v"].T


def gradients(p: Parameters, q: Parameters | None, x: np.ndarray) -> tuple[Parameters, Parameters, dict[str, float]]:
    """Summed over rows: gradients of the reconstructor's loss and of the discriminator's, and the losses.

    The losses are weight * mean absolute error of a row (+ softplus(-logit of its reconstruction)), and softplus(-logit of
    the row) + softplus(logit of its reconstruction).
    """
    h, back = forward(p, x)
    away = back - x
    slope = np.sign(away) / x.shape[1]
    found, told, losses = {}, {}, {"rows": float(len(x)), "error": float(np.abs(away).sum() / x.shape[1])}
    if q is not None:
        slope = WEIGHT * slope
        (real, r), (fake, f) = logits(q, x), logits(q, back)
        one, _ = _backward(q, x, real, -_sigmoid(-r))
        other, _ = _backward(q, back, fake, _sigmoid(f))
        told = {k: one[k] + other[k] for k in one}
        slope = slope + _backward(q, back, fake, -_sigmoid(-f))[1]
        losses |= {"fooled": float(_softplus(-f).sum()), "told": float((_softplus(-r) + _softplus(f)).sum())}
    inner = slope @ p["w2"].T * (1 - h * h)
    found = {"w1": (x - p["mean"]).T @ inner, "b1": inner.sum(0), "w2": h.T @ slope, "b2": slope.sum(0)}
    return found, told, losses


class Adam:
    """Moves parameters along gradients by means of the gradients and of their squares."""

    def __init__(self, rate: float):
        self.rate, self.n, self.first, self.second = rate, 0, {}, {}

    def step(self, p: Parameters, g: Parameters) -> Parameters:
        self.n += 1
        out = dict(p)
        for k, v in g.items():
            self.first[k] = DECAY[0] * self.first.get(k, 0.0) + (1 - DECAY[0]) * v
            self.second[k] = DECAY[1] * self.second.get(k, 0.0) + (1 - DECAY[1]) * v * v
            mean, square = self.first[k] / (1 - DECAY[0] ** self.n), self.second[k] / (1 - DECAY[1] ** self.n)
            out[k] = p[k] - self.rate * mean / (np.sqrt(square) + 1e-8)
        return out


def _packed(p: Parameters, q: Parameters | None, x: np.ndarray) -> np.ndarray:
    found, told, losses = gradients(p, q, x)
    return np.concatenate([*(v.ravel() for v in (*found.values(), *told.values())), list(losses.values())])


class Autoencoder:
    """fit(df) learns, residuals(df) gives what isn't rebuilt: the interface of LinearReconstructor."""

    def __init__(self, components: int, steps: int = 40, rate: float = 2e-3, adversarial: bool = False, discriminator: int = 16, batches: int = 1, seed: int = 0):
        self.components, self.steps, self.rate, self.adversarial, self.units, self.batches, self.seed = components, steps, rate, adversarial, discriminator, batches, seed
        self.parameters: Parameters = {}
        self.losses: list[dict[str, float]] = []

    def begin(self, linear: LinearReconstructor, dim: int) -> tuple[Parameters, Parameters | None]:
        """The linear reconstructor as a network, whose units stay in tanh's straight part; a discriminator drawn by the seed."""
        spread = np.sqrt(np.maximum(linear.spread, 1e-12))
        scale = 0.1 / spread
        p = {"mean": linear.mean, "w1": linear.axes * scale, "b1": np.zeros(len(scale)), "w2": linear.axes.T / scale[:, None], "b2": np.zeros(dim)}
        if not self.adversarial:
            return p, None
        rng = np.random.default_rng(self.seed)
        return p, {"v": rng.normal(0, dim**-0.5, (dim, self.units)), "c": np.zeros(self.units), "u": rng.normal(0, self.units**-0.5, self.units), "e": np.zeros(1)}

    def fit(self, df: DataFrame, feature: str, dim: int, ids: list[str] | None = None) -> Autoencoder:
        """Trains on all rows' vectors (arrays of `dim` numbers). A table without rows leaves the zero function around zero.

        With `batches` over 1 a step takes those rows whose hash of ids and step falls in one of as many parts. Rows are written
        to the shared folder once and read in each step; a lost executor costs its tasks alone, and steps are the same however
        rows are dealt, but for the last digits of sums.
        """
        ids = ids or []
        with kept(df.select(*ids, F.col(feature).cast("array<double>").alias("_x"))) as rows:
            linear = LinearReconstructor(self.components).fit(rows, "_x", dim)
            p, q = self.begin(linear, dim)
            movers = Adam(self.rate), Adam(self.rate)
            names, told = ["w1", "b1", "w2", "b2"], ["v", "c", "u", "e"] if q else []
            for step in range(self.steps):
                own = rows.where(F.pmod(F.xxhash64(F.lit(step + self.seed), *ids), F.lit(self.batches)) == 0) if self.batches > 1 else rows
                sums = summed(own, ["_x"], partial(_packed, p, q))
                if sums is None:
                    continue
                found, at = {}, 0
                for name in (*names, *told):
                    shape = (p | (q or {}))[name].shape
                    found[name] = sums[at : at + int(np.prod(shape))].reshape(shape)
                    at += int(np.prod(shape))
                losses = dict(zip(["rows", "error", "fooled", "told"], sums[at:], strict=False))
                n = losses.pop("rows")
                for mover in movers:
                    mover.rate = self.rate * (1 - step / self.steps)  # falls in a line, so that the last steps settle
                self.losses.append({k: v / n for k, v in losses.items()})
                if q:
                    q = movers[1].step(q, {k: found[k] / n for k in told})
                p = movers[0].step(p, {k: found[k] / n for k in names})
        self.parameters = p
        return self

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        return forward(self.parameters, x)[1]

    def residuals(self, df: DataFrame, feature: str, out: str) -> DataFrame:
        """df with x minus its reconstruction."""
        p = self.parameters

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def residual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                a = np.array(x.tolist(), np.float64)
                yield pd.Series(list(a - forward(p, a)[1]) if len(a) else [], dtype=object)

        return df.withColumn(out, residual(feature))
