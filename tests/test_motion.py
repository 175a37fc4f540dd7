"""Motion features, and the skewed background against closed forms and simulated data."""

import math
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgrid.functions import scalar as S
from quietgrid.operators import motion as M
from quietgrid.operators import skew as K


def test_block_matching_finds_a_shift(spark):
    rng = np.random.default_rng(0)
    old = rng.integers(0, 255, (24, 24), dtype=np.uint8)
    new = np.roll(old, (2, -1), (0, 1))
    df = spark.createDataFrame([("v", t, 24, 24, bytearray(a.tobytes())) for t, a in enumerate((old, new))], "video string, t int, h int, w int, px binary")
    rows = M.block_matching(df, ["video"], "t").collect()
    inner = [r for r in rows if r["y"] == 8 and r["x"] == 8]
    assert len(rows) == 9 and {(r["dx"], r["dy"]) for r in inner} == {(-1.0, 2.0)} and {r["t"] for r in rows} == {1}


def test_direction_bins(spark):
    turns = [0.0, 0.1, 1.0, 2.0, 3.2, 4.0, 5.5, 2 * math.pi - 1e-9]
    df = spark.createDataFrame([(i, math.cos(a), math.sin(a)) for i, a in enumerate(turns)], "i int, dx double, dy double")
    got = [r["b"] for r in df.select("i", S.direction_bin(F.col("dx"), F.col("dy")).alias("b")).orderBy("i").collect()]
    assert got == [min(int(a / (2 * math.pi) * 8), 7) for a in turns]


def test_log_domain(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, -5.0],)], "a array<double>")
    row = df.select(S.logsumexp(F.col("a")).alias("l"), S.softmax(F.col("a")).alias("p"), S.sigmoid(F.lit(0.0)).alias("s"), S.quantised(F.lit(3.0), 2.0).alias("q"), S.quantised(F.lit(9.0), 2.0).alias("full")).first()
    assert row["l"] == pytest.approx(1000 + math.log(2)) and row["p"] == pytest.approx([0.5, 0.5, 0.0]) and row["s"] == 0.5 and (row["q"], row["full"]) == (144, 255)


def test_bessel_functions():
    x = np.array([1e-3, 0.05, 0.5, 3.0, 40.0, 700.0])
    half = 0.5 * np.log(np.pi / (2 * x)) - x
    np.testing.assert_allclose(K.log_bessel_k(0.5, x), half, atol=1e-11)
    np.testing.assert_allclose(K.log_bessel_k(-2.5, x), half + np.log1p(3 / x + 3 / x**2), atol=1e-11)
    low, mid, high = (K.log_bessel_k(v, x) for v in (6.0, 7.0, 8.0))  # K8 = K6 + (14 / x) K7
    np.testing.assert_allclose(np.exp(low - high) + 14 / x * np.exp(mid - high), 1, atol=1e-11)


def test_skewed_density_has_mass_one():
    g = np.linspace(-60, 120, 1200)
    grid = np.array(np.meshgrid(g, g)).reshape(2, -1).T
    for gamma in (np.array([0.5, 0.2]), np.zeros(2)):
        m = K.SkewT(np.zeros(2), gamma, np.eye(2), 5.0)
        const = m.log_likelihood(grid[:1]) + m.score(grid[:1]).mean()
        assert np.exp(const - m.score(grid)).sum() * (g[1] - g[0]) ** 2 == pytest.approx(1, abs=2e-3)


def test_em_recovers_what_was_simulated():
    rng = np.random.default_rng(0)
    w = 1 / rng.gamma(2.5, 0.4, 20_000)
    x = np.array([1.0, 2.0]) + w[:, None] * np.array([0.8, 0.0]) + np.sqrt(w)[:, None] * rng.normal(size=(20_000, 2))
    m = K.fit(x, 5.0, 60)
    np.testing.assert_allclose(m.mu, [1, 2], atol=0.08)
    np.testing.assert_allclose(m.gamma, [0.8, 0], atol=0.08)
    assert m.log_likelihood(x) > K.fit(x, 50.0, 60).log_likelihood(x)


def test_every_row_counts_in_a_cells_fit(spark, monkeypatch):
    monkeypatch.setattr(K, "GRID", (5.0,))
    rng = np.random.default_rng(1)
    x = rng.standard_t(5, (5600, 2))
    x[5200:] += 1
    cells = np.arange(5600) // 5200
    rows = spark.createDataFrame([(i, int(c), v) for i, (c, v) in enumerate(zip(cells, x.tolist(), strict=True))], "id int, cell int, f array<double>")
    got = K.skewed_background(rows, "cell", "f", ["id"], rounds=3).orderBy("id").select("skew_t").toPandas()["skew_t"].to_numpy()
    scene = K.fit(x, 5.0, 3)
    for cell in (0, 1):
        m, a = K.fit(x[cells == cell], 5.0, 3), K.ALPHA
        near = K.SkewT(*((1 - a) * p + a * q for p, q in ((m.mu, scene.mu), (m.gamma, scene.gamma), (m.sigma, scene.sigma))), 5.0)
        np.testing.assert_allclose(got[cells == cell], near.score(x[cells == cell]), rtol=1e-6, atol=1e-6)


def test_a_round_works_on_each_vector_of_a_key_once(spark, monkeypatch):
    seen, kept = [], K.kept

    @contextmanager
    def counting(df):
        with kept(df) as rows:
            seen.append(rows.count())
            yield rows

    monkeypatch.setattr(K, "kept", counting)
    x = np.random.default_rng(2).standard_t(5, (40, 2)) + [0, 1]
    times = np.arange(40) % 7 * 10 + 1
    whole = np.repeat(x, times, 0)
    rows = spark.createDataFrame([(str(i % 2), v) for v in whole.tolist() for i in range(2)], "cell string, f array<double>").withColumn("nu", F.lit(5.0))
    few = spark.createDataFrame([("0", v, int(n)) for v, n in zip(x.tolist(), times, strict=True)], "cell string, f array<double>, n long").withColumn("nu", F.lit(5.0))
    want = K.fit(whole, 5.0, 4)
    for r in [*K.fits(rows, "cell", "f", "nu", 2, 4).collect(), *K.fits(few, "cell", "f", "nu", 2, 4, count="n").collect()]:
        np.testing.assert_allclose([*r["_mu"], *r["_gamma"], *r["_sigma"]], [*want.mu, *want.gamma, *want.sigma.ravel()], atol=1e-9)
    assert seen == [80, 40]


def test_every_row_counts_in_the_scenes_fit(spark):
    """Beyond the 200,000 rows that it once drew; vectors repeat, so that NumPy takes each with its count."""
    rows = spark.range(210_000).select("id", (F.col("id") % 2).alias("cell"), F.array(F.pmod(F.hash("id"), F.lit(7)) / 2 + F.col("id") % 2, (F.pmod(F.xxhash64("id"), F.lit(23)) / 8) ** 2).alias("f"))
    seen = rows.groupBy("cell", "f").count().toPandas()

    def fitted(own, nu):
        x, n = np.stack(own["f"].to_numpy()), own["count"].to_numpy(np.float64)
        m = K._start(K._moments(x, n)[None], 2, nu)
        mean = m.mu
        for _ in range(2):
            m = K._step(K._sums(x, n, mean, m), mean, nu)
        return m, m.constant() - n @ m.score(x) / n.sum()

    scene = max((fitted(seen, nu) for nu in K.GRID), key=lambda m: m[1])[0]
    got = {r["cell"]: r for r in K.skewed_fits(rows, "cell", "f", ["id"], rounds=2).collect()}
    for cell, own in seen.groupby("cell"):
        m, a = fitted(own, scene.nu)[0], K.ALPHA
        assert got[cell]["_nu"] == scene.nu
        for name, p, q in (("_mu", m.mu, scene.mu), ("_gamma", m.gamma, scene.gamma), ("_sigma", m.sigma.ravel(), scene.sigma.ravel())):
            np.testing.assert_allclose(got[cell][name], (1 - a) * p + a * q, rtol=1e-8, atol=1e-9)
