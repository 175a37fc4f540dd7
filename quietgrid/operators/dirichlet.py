"""Gaussian mixtures under a Dirichlet-process prior, fitted by variational inference.

Weights are a stick broken at Beta-distributed shares, truncated at a number of components; means and precisions have a
normal-Wishart prior around the data's own mean and covariance. A round is one pass over the rows, which sums up
responsibilities and moments in each task; everything else is small and done once a round. Sticks that the rows don't need
keep their prior and get no weight.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .mixture import Mixture, distances, logsumexp
from .sampling import cap
from .sums import summed

#: Components at most, weight from which one counts, ridge of the prior covariance, rounds at most, gain in nats a row that ends them.
MOST, ACTIVE, RIDGE, ROUNDS, TOLERANCE = 20, 0.01, 1e-4, 100, 1e-4


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln Gamma for positive x: six steps up, then the asymptotic series."""
    x = np.asarray(x, np.float64)
    y = x + 6
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - sum(1 / (x + i) for i in range(6))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


class DirichletMixture:
    """The posterior: Beta(a, b) for each stick but the last, normal-Wishart (m, beta, W, nu) for each component."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, most: int, concentration: float | None = None):
        self.k, self.d = most, len(mean)
        self.alpha, self.beta0, self.nu0 = concentration or 1 / most, 1.0, float(self.d)
        self.m0, self.c0 = mean, cov + RIDGE * np.eye(self.d)
        self.bounds: list[float] = []

    def update(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> None:
        """Takes over sums of responsibilities (K), of weighted rows (K, D) and of their products (K, D, D)."""
        self.a, self.b = 1 + n[:-1], self.alpha + n[::-1].cumsum()[::-1][1:]
        self.beta, self.nu = self.beta0 + n, self.nu0 + n
        mean = s1 / np.maximum(n, 1e-300)[:, None]
        scatter = s2 - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        away = mean - self.m0
        self.m = (self.beta0 * self.m0 + s1) / self.beta[:, None]
        pull = (self.beta0 * n / self.beta)[:, None, None] * away[:, :, None] * away[:, None, :]
        inverse = self.c0 + scatter + pull
        self.inverse = (inverse + np.swapaxes(inverse, 1, 2)) / 2
        self.w = np.linalg.inv(self.inverse)

    def _log_shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected logarithms of each stick's share, of what it leaves, and of the components' weights."""
        own, left = digamma(self.a) - digamma(self.a + self.b), digamma(self.b) - digamma(self.a + self.b)
        return own, left, np.append(own, 0.0) + np.append(0.0, left.cumsum())

    def _log_det(self) -> np.ndarray:
        half = (self.nu[:, None] - np.arange(self.d)) / 2
        return digamma(half).sum(1) + self.d * math.log(2) + np.linalg.slogdet(self.w)[1]

    def log_terms(self, x: np.ndarray) -> np.ndarray:
        """Expected log weight and density of each row and component (N, K)."""
        quad = self.d / self.beta + self.nu * distances(x, self.m, self.w)
        return self._log_shares()[2] + 0.5 * (self._log_det() - self.d * math.log(2 * math.pi) - quad)

    def divergence(self) -> float:
        """Of the posterior from the prior, in nats."""
        own, left, _ = self._log_shares()
        beta = lambda a, b: _lgamma(a) + _lgamma(b) - _lgamma(a + b)
        sticks = beta(np.ones_like(self.a), np.full_like(self.a, self.alpha)) - beta(self.a, self.b) + (self.a - 1) * own + (self.b - self.alpha) * left
        away, ratio = self.m - self.m0, self.beta0 / self.beta
        means = 0.5 * (self.d * (ratio - np.log(ratio) - 1) + self.beta0 * self.nu * np.einsum("kc,kcd,kd->k", away, self.w, away))

        def norm(log_det, nu):  # the constant of a Wishart density
            return -nu / 2 * log_det - nu * self.d / 2 * math.log(2) - self.d * (self.d - 1) / 4 * math.log(math.pi) - _lgamma((nu[:, None] - np.arange(self.d)) / 2).sum(1)

        prior = norm(np.full(self.k, -np.linalg.slogdet(self.c0)[1]), np.full(self.k, self.nu0))
        wishart = norm(np.linalg.slogdet(self.w)[1], self.nu) - prior + (self.nu - self.nu0) / 2 * self._log_det() + self.nu / 2 * (np.einsum("cd,kdc->k", self.c0, self.w) - self.d)
        return float(sticks.sum() + means.sum() + wishart.sum())

    @property
    def weights(self) -> np.ndarray:
        share = self.a / (self.a + self.b)
        return np.append(share, 1.0) * np.append(1.0, (1 - share).cumprod())

    def mixture(self) -> Mixture:
        """Expected weights, means and covariances, of which log densities are taken."""
        return Mixture(self.weights, self.m, self.inverse / self.nu[:, None, None], ridge=0.0)


def _moments(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(K, 1 + D + D * (D + 1) / 2): sums of responsibilities, of weighted rows and of their products, each pair once."""
    i, j = np.triu_indices(x.shape[1])
    return r.T @ np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], 1)


def _split(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.triu_indices(d)
    products = np.empty((len(sums), d, d))
    products[:, i, j] = products[:, j, i] = sums[:, 1 + d :]
    return sums[:, 0], sums[:, 1 : 1 + d], products


def centres(df: DataFrame, feature: str, ids: list[str], k: int, seed: int = 0, rounds: int = 5) -> np.ndarray:
    """Up to k means to begin with: rows drawn by a hash of seed and ids, moved by some rounds of k-means over all rows."""
    found = np.array([r[0] for r in cap(df.select(*ids, feature), ids, k, seed).orderBy(*ids).select(feature).collect()], np.float64)  # k rows
    found = found[np.sort(np.unique(found, axis=0, return_index=True)[1])]
    for _ in range(rounds):
        sums = summed(df, [feature], _nearest(found))
        found = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), found)
    return found


def hard(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """1 for the nearest centre of each row (the first of equals), else 0."""
    away = (x * x).sum(1)[:, None] - 2 * x @ found.T + (found * found).sum(1)
    return np.eye(len(found))[away.argmin(1)]


def _nearest(found: np.ndarray):
    return lambda x: hard(x, found).T @ np.concatenate([np.ones((len(x), 1)), x], 1)


def fit(df: DataFrame, feature: str, ids: list[str], most: int = MOST, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 0, begin: np.ndarray | None = None) -> DirichletMixture:
    """Fits `most` components at most to the vectors of all rows (arrays of one length, without nulls).

    Rounds end when the evidence bound gains less than tolerance a row; `bounds` holds it after each, and it never falls.
    begin: centres to begin with. Raises ValueError for a table without rows. Rows are written to the shared folder once, in
    equal parts for all cores however the input is filed, and read in every round, so a lost executor costs its tasks alone;
    they are deleted in the end.
    """
    with kept(df.select(*ids, F.col(feature).cast("array<double>").alias("_x")).repartition(df.sparkSession.sparkContext.defaultParallelism)) as rows:
        whole = summed(rows, ["_x"], lambda x: _moments(x, np.ones((len(x), 1))))
        if whole is None:
            raise ValueError("a mixture needs rows")
        d = (math.isqrt(8 * whole.shape[1] + 1) - 3) // 2
        n, s1, s2 = _split(whole, d)
        mean = s1[0] / n[0]
        cov = (s2[0] - n[0] * np.outer(mean, mean)) / max(n[0] - 1, 1)
        begin = centres(rows, "_x", ids, most, seed) if begin is None else begin
        model = DirichletMixture(mean, cov, most)
        start = np.zeros((most, whole.shape[1]))
        start[: len(begin)] = summed(rows, ["_x"], lambda x: _moments(x, hard(x, begin)))
        model.update(*_split(start, d))
        for _ in range(rounds):
            sums = summed(rows, ["_x"], _expect(model))
            model.bounds.append(float(sums[0, -1]) - model.divergence())
            model.update(*_split(sums[:, :-1], d))
            if len(model.bounds) > 1 and model.bounds[-1] - model.bounds[-2] < tolerance * n[0]:
                break
    return model


def _expect(model: DirichletMixture):
    """Moments by responsibility, with the rows' summed log evidence in a last column of the first row."""

    def part(x: np.ndarray) -> np.ndarray:
        out = None
        for at in range(0, len(x), 2048):  # bounds what a batch takes
            own = x[at : at + 2048]
            terms = model.log_terms(own)
            top = logsumexp(terms)
            sums = _moments(own, np.exp(terms - top[:, None]))
            sums = np.concatenate([sums, np.zeros((len(sums), 1))], 1)
            sums[0, -1] = top.sum()
            out = sums if out is None else out + sums
        return out

    return part
