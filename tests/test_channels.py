"""Flow channels of cells and frames against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from quietgrid.operators import channels as K
from quietgrid.operators import mixture as X
from quietgrid.operators import skew
from quietgrid.operators.sampling import cap


def features(spark, n=40, cells=3, bins=2, seed=0):
    rng = np.random.default_rng(seed)
    f = np.log1p(rng.gamma(2.0, 1.0, (n, cells, bins + 1)) * (1 + np.arange(cells))[None, :, None])
    return f, spark.createDataFrame([(t, c, f[t, c].tolist()) for t in range(n) for c in range(cells)], "frame int, cell_id int, f array<double>").repartition(3)


def precision(cov):
    d = len(cov)
    return np.linalg.inv(cov + (1e-3 * np.trace(cov) / d + 1e-8) * np.eye(d))


def test_every_cell_under_every_background(spark):
    f, df = features(spark)
    normal = df.where("frame < 30")
    rows = K.flow_channels(df, normal, ["frame"], bins=2, components=2, rounds=2).collect()
    got = {(r["frame"], r["cell_id"]): r for r in rows}
    assert len(got) == 120
    own = f[:30]
    g = own.reshape(-1, 3)
    gm, gc = g.mean(0), np.cov(g.T, bias=True)
    speeds = lambda x: np.stack([np.log1p(np.expm1(x[..., :2]).sum(-1)), x[..., 2]], -1)
    ubm = X.Mixture.fit(cap(normal.withColumn("s", K.speed(F.col("f"), 2)), ["frame", "cell_id"], X.ROWS), "s", 2)
    fits = {r["cell_id"]: r for r in skew.skewed_fits(normal, "cell_id", "f", ["frame", "cell_id"], rounds=2).collect()}
    for c in range(3):
        m, s = own[:, c].mean(0), np.cov(own[:, c].T, bias=True)
        p = precision((s + gc) / 2 + np.outer(m - gm, m - gm) / 4)
        x = speeds(own[:, c])
        terms = ubm.log_terms(x)
        gamma = np.exp(terms - X.logsumexp(terms)[:, None])
        n = gamma.sum(0)
        a = n / (n + 16)
        w = a * n / len(x) + (1 - a) * ubm.w
        mu = a[:, None] * (gamma.T @ x) / n[:, None] + (1 - a)[:, None] * ubm.mu
        w = w / w.sum()
        model = skew.SkewT(np.array(fits[c]["_mu"]), np.array(fits[c]["_gamma"]), np.reshape(fits[c]["_sigma"], (3, 3)), fits[c]["_nu"])
        for t in range(40):
            z = f[t, c] - (m + gm) / 2
            np.testing.assert_allclose(got[t, c][K.FLOW_RX], z @ p @ z, rtol=1e-6)
            terms = ubm.log_terms(speeds(f[t, c])[None], w[None], mu[None])
            np.testing.assert_allclose(got[t, c][K.FLOW_UBM], -X.logsumexp(terms)[0], rtol=1e-6)
            np.testing.assert_allclose(got[t, c][K.FLOW_ST], model.score(f[t, c][None])[0], rtol=1e-6)


def test_frames_take_the_largest_local_mean(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3, 2, 3))  # cells of 4 pixels over 7 by 10
    cells = spark.createDataFrame([(t, i, float(v[t].ravel()[i]), -1.0) for t in range(3) for i in range(6)], "frame int, cell_id int, a double, b double")
    got = {(r["frame"], r["channel"]): r["score"] for r in K.frame_channels(cells, ["frame"], ["a", "b"], 7, 10, 4, 3).collect()}
    for t in range(3):
        m = np.pad(np.kron(v[t], np.ones((4, 4)))[:7, :10], 1)
        want = max(m[y : y + 3, x : x + 3].sum() / 9 for y in range(7) for x in range(10))
        np.testing.assert_allclose(got[t, "a"], want)
        assert got[t, "b"] == max(-9 / 9, -4 / 9)
