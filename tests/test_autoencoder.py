"""The trained reconstructor: gradients by differences, steps by NumPy, and what training gains."""

import numpy as np
import pytest

from quietgrid.operators import autoencoder as E
from quietgrid.operators.reconstruct import LinearReconstructor
from quietgrid.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def curved(n=300, seed=0):
    """Rows near a curve in five dimensions, which no line follows."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(-2, 2, n)
    return np.stack([t, np.tanh(2 * t), t**2 / 4, -t, np.sin(t)], 1) + rng.normal(0, 0.02, (n, 5))


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>").repartition(parts)


def losses(p, q, x):
    _, _, found = E.gradients(p, q, x)
    return (E.WEIGHT * found["error"] + found["fooled"] if q else found["error"]), found.get("told", 0.0)


@pytest.mark.parametrize("adversarial", [False, True])
def test_gradients_are_differences(adversarial):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 5))
    p = {"mean": x.mean(0), "w1": rng.normal(size=(5, 3)), "b1": rng.normal(size=3), "w2": rng.normal(size=(3, 5)), "b2": rng.normal(size=5)}
    q = {"v": rng.normal(size=(5, 4)), "c": rng.normal(size=4), "u": rng.normal(size=4), "e": rng.normal(size=1)} if adversarial else None
    found, told, _ = E.gradients(p, q, x)
    step = 1e-6
    for params, grads, which in ((p, found, 0), (q or {}, told, 1)):
        for name, g in grads.items():
            for at in np.ndindex(g.shape):
                both = []
                for sign in (1, -1):
                    moved = {**params, name: params[name].copy()}
                    moved[name][at] += sign * step
                    both.append(losses(moved if which == 0 else p, moved if which else q, x)[which])
                assert (both[0] - both[1]) / (2 * step) == pytest.approx(g[at], abs=1e-5), (name, at)


def numpy_fit(x, components, steps, rate):
    """The same steps over a whole matrix, written apart."""
    mean = x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    order = np.argsort(values)[::-1][:components]
    scale = 0.1 / np.sqrt(values[order])
    p = [vectors[:, order] * scale, np.zeros(components), vectors[:, order].T / scale[:, None], np.zeros(x.shape[1])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for k in range(1, steps + 1):
        h = np.tanh((x - mean) @ p[0] + p[1])
        slope = np.sign(mean + h @ p[2] + p[3] - x) / x.size
        inner = slope @ p[2].T * (1 - h**2)
        for i, g in enumerate(((x - mean).T @ inner, inner.sum(0), h.T @ slope, slope.sum(0))):
            m[i] = 0.5 * m[i] + 0.5 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (1 - (k - 1) / steps) * (m[i] / (1 - 0.5**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return x - (mean + np.tanh((x - mean) @ p[0] + p[1]) @ p[2] + p[3])


def test_every_residual_is_numpys_at_any_number_of_partitions(spark):
    x = curved()
    want = numpy_fit(x, 2, 6, 1e-2)
    for parts in (1, 8):
        model = E.Autoencoder(2, steps=6, rate=1e-2).fit(frame(spark, x, parts), "f", 5, ["id"])
        got = {r["id"]: r["r"] for r in model.residuals(frame(spark, x, parts), "f", "r").collect()}
        np.testing.assert_allclose([got[i] for i in range(len(x))], want, atol=1e-7)


def test_training_beats_the_linear_model(spark):
    x = curved()
    df = frame(spark, x)
    linear = LinearReconstructor(1).fit(df, "f", 5)
    before = np.abs(x - linear.rebuild(x)).mean()
    model = E.Autoencoder(1, steps=40, rate=1e-2).fit(df, "f", 5, ["id"])
    assert model.losses[0]["error"] == pytest.approx(before, rel=0.02)  # it begins as the linear one
    assert np.abs(x - model.rebuild(x)).mean() < 0.95 * before


def test_the_query_on_embeddings(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    want = np.abs(numpy_fit(x, 8, 40, 2e-3)).mean(1)
    got = {r["vec_id"]: r["error"] for r in QUERIES["nonlinear_residual"](spark, DATA).collect()}
    np.testing.assert_allclose([got[r["vec_id"]] for r in rows], want, atol=1e-4)
    linear = LinearReconstructor(8).fit(spark.createDataFrame([(v.tolist(),) for v in x], "f array<double>"), "f", 64)
    assert np.mean(list(got.values())) < np.abs(x - linear.rebuild(x)).mean()


def test_discriminator_and_batches(spark):
    x = curved()
    model = E.Autoencoder(1, steps=8, rate=1e-2, adversarial=True, batches=3).fit(frame(spark, x), "f", 5, ["id"])
    assert len(model.losses) == 8 and all(np.isfinite(list(step.values())).all() and {"error", "fooled", "told"} == set(step) for step in model.losses)
    again = E.Autoencoder(1, steps=8, rate=1e-2, adversarial=True, batches=3).fit(frame(spark, x, 7), "f", 5, ["id"])
    np.testing.assert_allclose(model.rebuild(x), again.rebuild(x), atol=1e-8)


def test_no_rows(spark):
    model = E.Autoencoder(2, steps=3).fit(frame(spark, np.zeros((0, 5))), "f", 5)
    assert model.losses == [] and np.isfinite(model.rebuild(np.ones((1, 5)))).all()
