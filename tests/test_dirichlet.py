"""Dirichlet-process mixtures against NumPy, row by row."""

import math
from contextlib import contextmanager

import numpy as np
import pytest

from quietgrid.operators import dirichlet as D
from quietgrid.operators import latent as L
from quietgrid.operators.mixture import log_density
from quietgrid.plans import backgrounds

DATA = "/root/testdata/sf0.001"


def blobs(spark, seed=0, n=600, parts=4):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, s, (n // 3, 2)) for m, s in (((0, 0), 0.5), ((6, 1), 0.8), ((-3, 5), 0.3))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>").repartition(parts)


def reference(x, begin, most, rounds, alpha=None, ridge=1e-4):
    """The posterior by the textbook's equations, a component at a time."""
    n, d = x.shape
    alpha = alpha or 1 / most
    m0, c0 = x.mean(0), np.cov(x.T) + ridge * np.eye(d)
    r = np.zeros((n, most))
    r[np.arange(n), np.argmin(((x[:, None] - begin) ** 2).sum(2), 1)] = 1
    for step in range(rounds + 1):
        a, b, m, beta, nu, w = [], [], [], [], [], []
        for k in range(most):
            nk = r[:, k].sum()
            a.append(1 + nk)
            b.append(alpha + r[:, k + 1 :].sum())
            beta.append(1 + nk)
            nu.append(d + nk)
            mean = (r[:, k, None] * x).sum(0) / max(nk, 1e-300)
            m.append((m0 + nk * mean) / beta[-1])
            z = x - mean
            w.append(np.linalg.inv(c0 + (r[:, k, None] * z).T @ z + nk / beta[-1] * np.outer(mean - m0, mean - m0)))
        if step == rounds:
            break
        left, terms = 0.0, np.empty((n, most))
        for k in range(most):
            digamma = lambda v: float(D.digamma(np.array(v)))
            last = k == most - 1
            weight = left + (0 if last else digamma(a[k]) - digamma(a[k] + b[k]))
            left += 0 if last else digamma(b[k]) - digamma(a[k] + b[k])
            log_det = sum(digamma((nu[k] - i) / 2) for i in range(d)) + d * math.log(2) + math.log(np.linalg.det(w[k]))
            z = x - m[k]
            terms[:, k] = weight + 0.5 * (log_det - d * math.log(2 * math.pi) - d / beta[k] - nu[k] * np.einsum("nc,cd,nd->n", z, w[k], z))
        top = terms.max(1, keepdims=True)
        r = np.exp(terms - top)
        r /= r.sum(1, keepdims=True)
    shares = [a[k] / (a[k] + b[k]) for k in range(most - 1)] + [1.0]
    weights = [s * np.prod([1 - t for t in shares[:k]]) for k, s in enumerate(shares)]
    covs = [np.linalg.inv(w[k]) / nu[k] for k in range(most)]
    return np.array(weights), np.array(m), np.array(covs)


def density(x, weights, means, covs):
    out = np.zeros(len(x))
    for w, m, c in zip(weights, means, covs, strict=True):
        z = x - m
        out += w * np.exp(-0.5 * np.einsum("nc,cd,nd->n", z, np.linalg.inv(c), z)) / math.sqrt((2 * math.pi) ** x.shape[1] * np.linalg.det(c))
    return -np.log(out)


def test_digamma():
    x = np.array([0.05, 0.5, 1, 2, 10, 1e4])
    step = 1e-5
    wanted = [(math.lgamma(v * (1 + step)) - math.lgamma(v * (1 - step))) / (2 * v * step) for v in x]
    np.testing.assert_allclose(D.digamma(x), wanted, rtol=1e-5)
    assert abs(D.digamma(np.array(1.0)) + 0.5772156649015329) < 1e-10


def test_every_row_is_numpys(spark):
    x, df = blobs(spark)
    begin = x[[0, 250, 450, 10]]
    model = D.fit(df, "f", ["id"], 8, rounds=7, tolerance=0, begin=begin)
    want = reference(x, begin, 8, 7)
    for got, w in zip((model.weights, model.m, model.mixture().cov), want, strict=True):
        np.testing.assert_allclose(got, w, atol=1e-8)
    got = {r["id"]: r["s"] for r in log_density(df, "f", model.mixture(), "s").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], density(x, *want), atol=1e-7)


def test_the_bound_never_falls_and_unused_sticks_die(spark):
    _, df = blobs(spark, 3)
    model = D.fit(df, "f", ["id"], 12, rounds=60, tolerance=1e-5)
    gains = np.diff(model.bounds)
    assert len(gains) > 3 and (gains > -1e-6).all()
    mixture = model.mixture()
    assert 3 <= (mixture.w > D.ACTIVE).sum() < 12 and abs(mixture.w.sum() - 1) < 1e-12
    assert len(L.active(mixture).w) == (mixture.w > D.ACTIVE).sum()
    assert np.sort(mixture.w)[-3:].sum() > 0.95


def test_partitions_change_nothing(spark):
    one, eight = (D.fit(blobs(spark, 1, parts=p)[1], "f", ["id"], 5, rounds=10, tolerance=0) for p in (1, 8))
    np.testing.assert_allclose(one.m, eight.m, atol=1e-8)
    np.testing.assert_allclose(one.bounds, eight.bounds, rtol=1e-10)


def test_awkward_tables(spark):
    with pytest.raises(ValueError, match="rows"):
        D.fit(blobs(spark)[1].where("false"), "f", ["id"], 3)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, f array<double>")
    model = D.fit(same, "f", ["id"], 4)
    assert np.isfinite(model.bounds).all() and np.allclose(model.m[model.weights.argmax()], [1, 2])


def test_query_scores_every_code(spark):
    """code_mixture on the table, against NumPy's principal components and posterior."""
    rows = backgrounds.placed_codes(spark, DATA).orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    place = np.array([(r["px"], r["py"]) for r in rows])
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :16]
    code = x @ axes
    code = np.concatenate([code, (place - 0.5) / 0.2887 * code.std(0, ddof=1).mean() * 2], 1)
    scored = {r["vec_id"]: r["s"] for r in L.code_mixture(backgrounds.placed_codes(spark, DATA), "embedding", ["vec_id"], "s", ["px", "py"], rounds=4, tolerance=0, begin=None).collect()}
    begin = D.centres(spark.createDataFrame([(r["vec_id"], c.tolist()) for r, c in zip(rows, code, strict=True)], "vec_id long, c array<double>"), "c", ["vec_id"], 20)
    want = density(code, *reference(code, begin, 20, 4))
    np.testing.assert_allclose([scored[r["vec_id"]] for r in rows], want, atol=1e-5)


def test_states_are_the_likeliest_components(spark):
    x, df = blobs(spark, 5)
    got = {r["id"]: r["state"] for r in L.scene_states(df, df.where("id % 2 = 0"), "f", ["id"], rounds=5, tolerance=0).collect()}
    mixture = L.active(D.fit(df.where("id % 2 = 0"), "f", ["id"], 6, rounds=5, tolerance=0).mixture())
    terms = np.stack([np.log(w) - density(x, [1.0], [m], [c]) for w, m, c in zip(mixture.w, mixture.mu, mixture.cov, strict=True)], 1)
    assert [got[i] for i in range(len(x))] == terms.argmax(1).tolist()


def test_rounds_use_all_cores_however_rows_are_filed(spark, monkeypatch):
    parts, kept = [], D.kept

    @contextmanager
    def noting(df):
        with kept(df) as rows:
            parts.append(rows.rdd.getNumPartitions())
            yield rows

    monkeypatch.setattr(D, "kept", noting)
    D.fit(blobs(spark, 1, parts=1)[1], "f", ["id"], 2, rounds=1)
    assert parts == [spark.sparkContext.defaultParallelism]
