"""Detectors of whole frames against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgrid.operators import background as B
from quietgrid.operators import bundle as U

H, W, CELL = 6, 8, 4


def maps(spark, dim, n=6, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, H, W, dim)) * (1 + np.arange(H)[None, :, None, None])
    rows = [(t, y, x, v[t, y, x].tolist() if dim > 1 else float(v[t, y, x, 0])) for t in range(n) for y in range(H) for x in range(W)]
    return v, spark.createDataFrame(rows, f"frame int, y int, x int, r {'array<double>' if dim > 1 else 'double'}").repartition(3)


def precision(cov):
    d = len(cov)
    return np.linalg.inv(cov + (1e-3 * np.trace(cov) / d + 1e-8) * np.eye(d))


def cells(v):
    return (np.arange(H)[:, None] // CELL * -(-W // CELL) + np.arange(W)[None, :] // CELL).ravel()


def shrunk(v):
    """(mean, covariance) of each cell, half-way to the scene's."""
    flat, own = v.reshape(len(v), H * W, -1), cells(v)
    d = flat.shape[-1]
    g = flat.reshape(-1, d)
    gm, gc = g.mean(0), np.cov(g.T, bias=True).reshape(d, d)
    out = {}
    for c in np.unique(own):
        x = flat[:, own == c].reshape(-1, d)
        m, s = x.mean(0), np.cov(x.T, bias=True).reshape(d, d)
        out[c] = (m + gm) / 2, (s + gc) / 2 + np.outer(m - gm, m - gm) / 4
    return out


@pytest.mark.parametrize("dim", [1, 2, 9])
def test_weighted_rx_of_any_length(spark, dim):
    v, df = maps(spark, dim)
    weight = F.col("y") + F.col("x") * 0.5
    got = {(r["frame"], r["y"], r["x"]): r["wrx"] for r in B.weighted_rx(df.withColumn("c", weight), ["frame"], "r", "c", dim=dim).collect()}
    w = 1 / (np.add.outer(np.arange(H), np.arange(W) * 0.5).ravel() + 1e-6)
    w = w / w.sum()
    for t in range(len(v)):
        x = v[t].reshape(H * W, dim)
        z = x - w @ x
        p = precision((z * w[:, None]).T @ z)
        want = np.einsum("nc,cd,nd->n", z, p, z).reshape(H, W)
        np.testing.assert_allclose([[got[t, y, x] for x in range(W)] for y in range(H)], want, rtol=1e-6)


@pytest.mark.parametrize("dim", [1, 2, 9])
def test_state_distances(spark, dim):
    v, df = maps(spark, dim, n=7)
    states = [0, 0, 1, 1, 1, 0, 2]  # the last state has no normal frame
    table = spark.createDataFrame(list(enumerate(states)), "frame int, state int")
    normal = df.where("frame < 5")
    got = {(r["frame"], r["y"], r["x"]): r["frx_state"] for r in U.state_distances(df, table, normal, ["frame"], "r", CELL, W, dim).collect()}
    base, own = shrunk(v[:5]), cells(v)
    flat = v.reshape(7, H * W, dim)
    for t, state in enumerate(states):
        frames = [k for k in range(5) if states[k] == state]
        for i in range(H * W):
            m0, c0 = base[own[i]]
            if frames:
                x = flat[frames][:, own == own[i]].reshape(-1, dim)
                m, s = x.mean(0), np.cov(x.T, bias=True).reshape(dim, dim)
                a = len(frames) / (len(frames) + 20)
                mu, cov = a * m + (1 - a) * m0, a * s + (1 - a) * c0 + a * (1 - a) * np.outer(m - m0, m - m0)
            else:
                mu, cov = m0, c0
            z = flat[t, i] - mu
            assert got[t, i // W, i % W] == pytest.approx(z @ precision(cov) @ z, rel=1e-6)


def test_fused_is_a_sum_of_z_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(t, d, float(rng.normal())) for t in range(8) for d in ("frx_bayes", "bgmm", "rem") if not (t == 7 and d == "bgmm")]
    scores = spark.createDataFrame(rows, "frame int, detector string, score double")
    normal = spark.createDataFrame([(t,) for t in range(4)], "frame int")
    got = {(r["frame"], r["detector"]): r["score"] for r in U.fuse_frames(scores, normal, ["frame"]).collect()}
    by = {(t, d): s for t, d, s in rows}
    assert {k: v for k, v in got.items() if k[1] != "fused"} == by
    for t in range(7):
        want = 0
        for d in ("frx_bayes", "bgmm"):
            own = [by[k, d] for k in range(4)]
            want += (by[t, d] - np.mean(own)) / (np.std(own) + 1e-12)
        assert got[t, "fused"] == pytest.approx(want)
    assert (7, "fused") not in got


def test_all_detectors_of_maps(spark):
    v, df = maps(spark, 1, n=10)
    normal = spark.createDataFrame([(t,) for t in range(6)], "frame int")
    got = U.all_scores(df, normal, ["frame"], "r", H, W, CELL, 2, 2, 3, 3, nu=5.0, code=3, states=2).toPandas().pivot(index="frame", columns="detector", values="score")
    assert set(got.columns) == {"rem", "frx_global", "frx_cell", "frx_bayes", "frx_t", "wrx", "frx_state", "bgmm", "fused"} and len(got) == 10 and np.isfinite(got.to_numpy()).all()
    base, own = shrunk(v[:6]), cells(v)
    flat = v.reshape(10, H * W)
    d = np.array([[(flat[t, i] - base[own[i]][0][0]) ** 2 * precision(base[own[i]][1])[0, 0] for i in range(H * W)] for t in range(10)]).reshape(10, H, W)
    padded = np.pad(d, ((0, 0), (1, 1), (1, 1)))
    best = [max(padded[t, y : y + 2, x : x + 2].sum() / 4 for y in range(H + 1) for x in range(W + 1)) for t in range(10)]
    np.testing.assert_allclose(got["frx_bayes"], best, rtol=1e-6)
    z = sum((got[n] - got[n][:6].mean()) / (got[n][:6].std(ddof=0) + 1e-12) for n in ("frx_bayes", "bgmm"))
    np.testing.assert_allclose(got["fused"], z, atol=1e-9)
