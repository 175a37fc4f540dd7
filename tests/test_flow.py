"""Dense flow: drawn shifts come back, fits are least squares, features are those of the pixels' rows."""

import numpy as np
import pytest

from quietgrid.operators import flow as O
from quietgrid.operators import motion as M


def texture(shift=(0.0, 0.0), h=64, w=80, seed=0):
    """A sum of waves, drawn exactly at any shift (dx, dy)."""
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w)).astype(float)
    x, y = x - shift[0], y - shift[1]
    waves = [(rng.uniform(0.05, 0.5), rng.uniform(0, 2 * np.pi), rng.uniform(0, 2 * np.pi)) for _ in range(40)]
    v = sum(np.sin(f * (np.cos(a) * x + np.sin(a) * y) + p) for f, a, p in waves)
    return np.clip(127 + 6 * v, 0, 255)


def test_an_expansion_is_a_weighted_least_squares_fit():
    frame = texture()
    got = O.expansion(frame)
    w = O._gaussian(O.FIT)
    reach = len(w) // 2
    y, x = np.meshgrid(range(-reach, reach + 1), range(-reach, reach + 1), indexing="ij")
    basis = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y], -1).reshape(-1, 6)
    root = np.sqrt(np.outer(w, w)).ravel()
    for cy, cx in ((20, 30), (40, 11)):
        own = frame[cy - reach : cy + reach + 1, cx - reach : cx + reach + 1].ravel()
        want = np.linalg.lstsq(basis * root[:, None], own * root, rcond=None)[0]
        np.testing.assert_allclose(got[cy, cx], want[1:], atol=1e-9)


@pytest.mark.parametrize("shift", [(0.25, 0.0), (0.0, -0.5), (1.3, 0.7), (-2.5, 3.25), (4.0, -4.0), (6.0, 0.0)])
def test_shifts_come_back(shift):
    d = O.dense_flow(np.round(texture()).astype(np.uint8), np.round(texture(shift)).astype(np.uint8))
    inner = d[16:-16, 16:-16]
    assert np.abs(np.median(inner.reshape(-1, 2), 0) - shift).max() < 0.1
    assert np.quantile(np.abs(inner - shift), 0.9) < 0.1


def test_flat_and_small_frames():
    flat = np.full((20, 20), 7, np.uint8)
    assert np.abs(O.dense_flow(flat, flat)).max() < 1e-9
    for shape in ((1, 1), (1, 5), (3, 2)):
        assert np.isfinite(O.dense_flow(np.zeros(shape, np.uint8), np.ones(shape, np.uint8))).all()


def frames(spark, n=4):
    px = [bytes(np.clip(np.round(texture((1.5 * t, -t), 20, 28)), 0, 255).astype(np.uint8).tobytes()) for t in range(n)]
    return spark.createDataFrame([(v, t, 20, 28, px[t]) for v in "ab" for t in range(n)] + [("c", 0, 20, 28, px[0])], "video string, t int, h int, w int, px binary").repartition(3)


def test_rows_of_a_video(spark):
    df = frames(spark)
    rows = O.optical_flow(df, ["video"], "t").toPandas()
    assert len(rows) == 2 * 3 * 20 * 28
    images = {t: np.frombuffer(p, np.uint8).reshape(20, 28) for t, p in df.where("video = 'a'").select("t", "px").collect()}
    for (_, t), own in rows.groupby(["video", "t"]):
        own = own.sort_values(["y", "x"])
        np.testing.assert_allclose(own[["dx", "dy"]].to_numpy().reshape(20, 28, 2), O.dense_flow(images[t - 1], images[t]), atol=1e-12)


def test_features_are_those_of_the_rows(spark):
    df = frames(spark)
    slow = {(r["video"], r["t"], r["cell_id"]): r["f"] for r in M.flow_features(O.optical_flow(df, ["video"], "t"), ["video", "t"], 8, 28).collect()}
    fast = {(r["video"], r["t"], r["cell_id"]): r["f"] for r in O.dense_flow_features(df, ["video"], "t", 8).collect()}
    assert len(fast) == 9 * 12
    for (v, t, c), f in fast.items():
        want = [0.0] * 9 if v == "c" else slow[v, max(t, 1), c]
        np.testing.assert_allclose(f, want, atol=1e-9)
