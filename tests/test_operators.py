"""Operators against NumPy, and the rules that their edges follow."""

import json
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quietgrid.operators import background as B
from quietgrid.operators import calibrate as C
from quietgrid.operators import grid as G
from quietgrid.operators import metrics as M
from quietgrid.operators import mixture as X
from quietgrid.operators import relational as R
from quietgrid.operators import temporal as T
from quietgrid.operators.ranking import counts_below, quantile
from quietgrid.sources import frames as S
from quietgrid.sources import sinks

CALM = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SERIES = st.lists(st.integers(-50, 50).map(lambda v: v / 4), min_size=1, max_size=40)


def series(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "video string, t int, x double")


def column(df, name="s"):
    return [r[name] for r in df.orderBy("t").collect()]


BY = (["video"], "t", "x", "s")


@CALM
@given(SERIES)
def test_medians_and_kalman(spark, values):
    s, n = np.array(values, float), len(values)
    df = series(spark, values)
    assert column(T.centred_median(df, *BY)) == [float(np.median([s[min(max(i + k, 0), n - 1)] for k in range(-4, 5)])) for i in range(n)]
    padded = np.concatenate([np.full(8, s[0]), s])
    assert column(T.causal_median_padded(df, *BY)) == [float(np.median(padded[i : i + 9])) for i in range(n)]
    assert column(T.causal_median(df, *BY)) == [float(np.median(s[max(0, i - 8) : i + 1])) for i in range(n)]
    g = T.steady_gain(0.05)
    x, forward = s[0], []
    for z in s:
        x += g * (z - x)
        forward.append(x)
    np.testing.assert_allclose(column(T.causal_kalman(df, *BY, g)), forward, atol=1e-9)


def test_gain_is_a_fifth():
    assert T.steady_gain(0.05) == pytest.approx(0.2)


@CALM
@given(SERIES)
def test_gaussian_edges(spark, values):
    s, n = np.array(values, float), len(values)
    w = np.exp(-0.5 * (np.arange(-12, 13) / 3) ** 2)
    w /= w.sum()
    near = [sum(w[k + 12] * s[min(max(i + k, 0), n - 1)] for k in range(-12, 13)) for i in range(n)]
    mirror = lambda i: (m := i % (2 * n), m if m < n else 2 * n - 1 - m)[1]
    reflect = [sum(w[k + 12] * s[mirror(i + k)] for k in range(-12, 13)) for i in range(n)]
    np.testing.assert_allclose(column(T.gaussian(series(spark, values), *BY)), near, atol=1e-9)
    np.testing.assert_allclose(column(T.gaussian(series(spark, values), *BY, mode="reflect")), reflect, atol=1e-9)


def test_short_series(spark):
    df = series(spark, [1.0, 2.0, 4.0])
    assert [r["s"] for r in T.clips(df, *BY, length=4, step=2).orderBy("t").collect()] == [[1.0, 1.0, 1.0, 4.0]] * 3
    assert column(T.lag_difference(df, *BY, gap=2)) == [3.0, 3.0, 3.0]
    assert column(T.lag_difference(series(spark, [1.0]), *BY, gap=2)) == [None]


def maps(spark, a, name="f"):
    return spark.createDataFrame([(name, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "frame string, y int, x int, v double")


@pytest.mark.parametrize("size", [3, 4])
def test_even_windows_have_one_more_position(spark, size):
    a = np.random.default_rng(2).normal(-1, 1, (6, 5))
    p = size // 2
    padded = np.pad(a, p)
    positions = [padded[i : i + size, j : j + size].sum() / size**2 for i in range(a.shape[0] + 2 * p - size + 1) for j in range(a.shape[1] + 2 * p - size + 1)]
    got = G.frame_score(maps(spark, a), ["frame"], "v", 6, 5, size).first()["score"]
    assert got == pytest.approx(max(positions), abs=1e-12)


def test_patches_cover_the_padded_map(spark):
    assert G.patch_starts(10, 4, 4) == [0, 4, 8] and G.patch_starts(3, 4, 2) == [0] and G.patch_starts(8, 4, 2) == [0, 2, 4]
    a = np.arange(30.0).reshape(5, 6)
    rows = {(r["py"], r["px"]): r["values"] for r in G.extract_patches(maps(spark, a), ["frame"], "v", 5, 6, 4, 2).collect()}
    mirrored = np.pad(a, ((0, 1), (0, 0)), mode="reflect")
    assert set(rows) == {(y, x) for y in (0, 2) for x in (0, 2)}
    assert rows[2, 2] == mirrored[2:6, 2:6].ravel().tolist()


def vectors(spark, x, cells):
    return spark.createDataFrame([(i, int(c), [float(v) for v in f]) for i, (f, c) in enumerate(zip(x, cells, strict=True))], "i int, cell int, f array<double>")


@pytest.mark.parametrize("dim", [2, 8])
def test_background_in_both_forms(spark, dim):
    rng = np.random.default_rng(dim)
    x, cells = rng.normal(size=(200, dim)), rng.integers(0, 3, 200)
    df = vectors(spark, x, cells)
    bg = B.finalise(B.moments(df, ["cell"], "f", dim), ["cell"], dim)
    got = {r["i"]: r["frx_bayes"] for r in B.detectors(df, bg, ["cell"], "f", dim).collect()}
    gm, gc = x.mean(0), np.cov(x.T, bias=True)
    for c in range(3):
        own = x[cells == c]
        m, v = own.mean(0), np.cov(own.T, bias=True)
        mu, cov = (m + gm) / 2, (v + gc) / 2 + np.outer(m - gm, m - gm) / 4
        p = np.linalg.inv(cov + (1e-3 * np.trace(cov) / dim + 1e-8) * np.eye(dim))
        for i in np.flatnonzero(cells == c):
            assert got[i] == pytest.approx((x[i] - mu) @ p @ (x[i] - mu), rel=1e-7)


def test_shrinkage_limits_and_infinite_prior(spark):
    rng = np.random.default_rng(0)
    df = vectors(spark, rng.normal(size=(120, 2)), rng.integers(0, 2, 120))
    m = B.moments(df, ["cell"], "f", 2)
    own, scene = (B.finalise(m, ["cell"], 2, alpha=a).orderBy("cell").collect() for a in (0.0, 1.0))
    for r in own:
        np.testing.assert_allclose(r["prec_b"], r["prec_c"], rtol=1e-8)
    for r in scene:
        np.testing.assert_allclose(r["prec_b"], r["prec_g"], rtol=1e-8)
    states = df.selectExpr("*", "i % 2 as state")
    base = B.finalise(m, ["cell"], 2)
    seen = spark.createDataFrame([(0, 10), (1, 10)], "state int, frames int")
    free = B.state_background(B.moments(states, ["state", "cell"], "f", 2), seen, base, "state", "cell", 2, float("inf"))
    prec = {r["cell"]: r["prec_b"] for r in base.collect()}
    for r in free.collect():
        np.testing.assert_allclose(r["prec"], prec[r["cell"]], rtol=1e-8)


def test_adapted_mixture(spark):
    rng = np.random.default_rng(1)
    x, cells = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(5, 1, (60, 2))]), rng.integers(0, 2, 120)
    ubm = X.Mixture([0.5, 0.5], [[0, 0], [5, 5]], [np.eye(2), np.eye(2)])
    df = vectors(spark, x, cells)
    got = {r["cell"]: r for r in X.adapt(df, "cell", "f", ubm).collect()}
    for c in (0, 1):
        own = x[cells == c]
        t = ubm.log_terms(own)
        gamma = np.exp(t - X.logsumexp(t)[:, None])
        n = gamma.sum(0)
        a = n / (n + 16)
        w = a * n / len(own) + (1 - a) * 0.5
        np.testing.assert_allclose(got[c]["w"], w / w.sum(), rtol=1e-9)
        np.testing.assert_allclose(np.reshape(got[c]["mu"], (2, 2)), a[:, None] * (gamma.T @ own) / n[:, None] + (1 - a)[:, None] * ubm.mu, rtol=1e-9)
    states = {r["i"]: r["s"] for r in X.assign(df, "f", ubm, "s").collect()}
    assert all(states[i] == int(ubm.log_terms(x[i : i + 1]).argmax()) for i in range(120))
    scored = X.score(df, X.adapt(df, "cell", "f", ubm), "cell", "f", ubm, "s")
    assert scored.count() == 120 and scored.where("s is null or isnan(s)").count() == 0


@CALM
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.lists(st.integers(0, 12), min_size=1, max_size=60))
def test_counts_below_is_a_left_search(spark, queries, reference):
    q = spark.createDataFrame([(i, float(v)) for i, v in enumerate(queries)], "i int, v double")
    r = spark.createDataFrame([(float(v),) for v in reference], "v double")
    got = {x["i"]: x["n"] for x in counts_below(q, r, [], "v", "n").collect()}
    assert [got[i] for i in range(len(queries))] == np.searchsorted(np.sort(reference), queries, "left").tolist()


@CALM
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40), st.lists(st.floats(allow_nan=False) | st.sampled_from([0.0, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, -1.0, 5e-324]), min_size=1, max_size=40))
def test_counts_below_over_all_floats(spark, queries, reference):
    q = spark.createDataFrame([(i, v) for i, v in enumerate(queries)], "i int, v double")
    r = spark.createDataFrame([(v,) for v in reference], "v double")
    got = {x["i"]: x["n"] for x in counts_below(q, r, [], "v", "n").collect()}
    assert [got[i] for i in range(len(queries))] == np.searchsorted(np.sort(reference), queries, "left").tolist()


@CALM
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.5, 0.9, 0.995, 1.0]))
def test_quantiles_are_exact(spark, values, q):
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    assert quantile(df, ["k"], "v", q, "u").first()["u"] == pytest.approx(np.quantile(values, q))
    assert quantile(df, [], "v", q, "u").first()["u"] == pytest.approx(np.quantile(values, q))


@CALM
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=50))
def test_auc_counts_ties_half(spark, rows):
    df = spark.createDataFrame([(float(s), y) for s, y in rows], "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if pos and neg else None
    got = M.auc(df, "s", "y").first()["auc"]
    assert got is None if want is None else got == pytest.approx(want)


def test_single_class_series_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 3.0, 0), ("b", 4.0, 0)], "video string, s double, y int")
    assert M.macro_auc(df, "s", "y", "video").first().asDict() == {"series": 1, "auc": 1.0}


def test_one_video_has_an_empty_other_fold(spark):
    df = C.folds(spark.createDataFrame([("a", 1.0)], "video string, s double"), [], "video")
    assert C.z_scores(df, df.where("fold = 1"), ["fold"], "s").count() == 0


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "é"), (3, "")], "k int, text string")
    got = {r["k"]: r["fp"] for r in R.fingerprint(df, ["k"], "text").collect()}
    assert got == {k: f"{len(b)}:{zlib.crc32(b)}" for k, b in ((1, b"abc"), (2, "é".encode()), (3, b""))}
    cached = spark.createDataFrame([(1, got[1]), (2, "x"), (3, None)], "k int, fp string")
    assert [r["k"] for r in R.stale(R.fingerprint(df, ["k"], "text"), cached, ["k"]).collect()] == [2]


def test_sources(spark, tmp_path):
    root = tmp_path / "cache"
    (root / "ped" / "test").mkdir(parents=True)
    video = np.arange(24, dtype=np.uint8).reshape(4, 2, 3)
    np.save(root / "ped" / "test" / "v1.npy", video)
    (root / "ped" / "gt.json").write_text(json.dumps({"v1": [0, 1, 1]}))
    frames = S.read_cache(spark, str(root))
    rows = frames.orderBy("t").collect()
    assert [(r["scene"], r["split"], r["video"], r["t"], r["h"], r["w"]) for r in rows] == [("ped", "test", "v1", t, 2, 3) for t in range(4)]
    assert bytes(rows[2]["px"]) == video[2].tobytes()
    labels = S.read_labels(spark, str(root / "*" / "gt.json"))
    assert R.labelled(frames, labels, ["scene", "video", "t"]).count() == 3
    assert [r.asDict() for r in R.length_mismatches(frames, labels, "video").collect()] == [{"video": "v1", "frames": 4, "labels": 3}]
    assert S.constant_size(frames, ["scene"]).count() == 0
    text = spark.createDataFrame([("m", "TestVideoFile{1}.gt_frame = [61:63];\nTestVideoFile{2}.gt_frame = [5:6, 9:9];")], "f string, text string")
    got = sorted((r["ordinal"], r["start"], r["stop"]) for r in S.label_ranges(text, "text", ["f"]).collect())
    assert got == [(0, 60, 62), (1, 4, 5), (1, 8, 8)]
    folder = root / "img" / "v9"
    folder.mkdir(parents=True)
    for i, content in enumerate([b"P5\n2 1\n255\n\x01\x02", b"broken", b"P5\n2 1\n255\n\x03\x04"]):
        (folder / f"{i}.pgm").write_bytes(content)
    images = S.read_images(spark, str(folder), r"([^/]+)/[^/]+\.pgm$", ["video"], S.decode_pgm).orderBy("t").collect()
    assert [bytes(r["px"]) for r in images] == [b"\1\2", b"\1\2", b"\3\4"]
    sinks.write_partitioned(frames, str(tmp_path / "out"), ["scene", "split"])
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'test'").count() == 4
    (root / "run" / "eval_a").mkdir(parents=True)
    (root / "run" / "eval_a" / "results.json").write_text(json.dumps({"auc": {"rem/raw": {"auc": 0.5, "eer": 0.4}}}))
    res = S.read_results(spark, str(root / "run" / "*" / "results.json"))
    assert res.first().asDict() == {"run": "run", "detector": "rem", "post": "raw", "auc": 0.5, "eer": 0.4}
    assert "0.5" in sinks.markdown(sinks.pivot_table(res, "detector", "post", "auc"))


def test_linear_reconstruction(spark):
    from quietgrid.operators.reconstruct import LinearReconstructor, overlap_residual

    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 4)) + rng.normal(scale=0.1, size=(50, 4))
    df = vectors(spark, x, np.zeros(50))
    m = LinearReconstructor(2).fit(df, "f", 4)
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    want = centred - centred @ axes.T @ axes
    got = np.array([r["r"] for r in m.residuals(df, "f", "r").orderBy("i").collect()])
    np.testing.assert_allclose(got, want, atol=1e-9)
    patches = spark.createDataFrame([("f", 0, 0, [1.0, 2.0, 3.0, 4.0]), ("f", 0, 1, [5.0, 6.0, 7.0, 8.0])], "frame string, py int, px int, r array<double>")
    rows = {(r["y"], r["x"]): r["r"] for r in overlap_residual(patches, "r", ["frame"], 2, 2, 2).collect()}
    assert rows == {(0, 0): 1.0, (0, 1): 3.5, (1, 0): 3.0, (1, 1): 5.5}
