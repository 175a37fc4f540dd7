import numpy as np
import pandas as pd
import pytest

from quietgrid.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, n string, cells int"


def brute(rows, cosine=0.93):
    def ok(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i][:3], rows[j][:3]
            if ok(a, la) and ok(b, lb) and la == lb and len(a) == len(b):
                x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], links[i], min(ids, default=None)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "n", 1) for r in rows], SCHEMA)
    got = E.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=str)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 0), (12, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (13, [0.0, 1.0], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []


@pytest.mark.parametrize(("seed", "cells"), [(0, 4096), (1, 4096), (2, 4)])
def test_cells_lose_no_pair(spark, seed, cells, monkeypatch):
    """Many small cells and blocks, so that nearly every group is cut by borders; with few first cells, they are cut again."""
    if cells == 4:
        monkeypatch.setattr(E, "LARGE", 1)
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, 6))
    rows = [(int(i), [float(v) for v in heads[i % 12] + rng.normal(scale=0.25, size=6)], int(i % 12 == 0)) for i in range(260)]
    assert run(spark, rows, cell=16, cells=cells, block=20) == brute(rows)
    assert any(n > 3 for _, n, _ in brute(rows))


def test_hot_vector(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(300)] + [(1000, [1.0, 2.1], 0), (1001, [-1.0, 0.0], 0)]
    assert run(spark, rows, block=8, copies=64) == run(spark, rows) == brute(rows)


def test_squares_that_overflow_or_vanish(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 1e190]), (3, [1e-200, 0.0]), (4, [1.0, 0.001]), (5, [0.0, 5e-324]), (6, [0.0, 1.7e308]), (7, [-1e-300, 1e-320])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


@pytest.mark.parametrize(("seed", "cells"), [(3, 4096), (4, 4)])
def test_cells_lose_no_pair_where_they_cut_badly(spark, seed, cells, monkeypatch):
    """Cells that most vectors visit are kept, so pairs meet several times."""
    if cells == 4:
        monkeypatch.setattr(E, "LARGE", 1)
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, 6))
    rows = [(int(i), [float(v) for v in heads[i % 12] + rng.normal(scale=0.25, size=6)], int(i % 12 == 0)) for i in range(260)]
    assert run(spark, rows, cell=16, cells=cells, block=20, gain=0) == brute(rows)


def test_parts_of_a_product(spark, monkeypatch):
    """A tile taken in parts of 7 gives what it gives whole; chains of links cross the parts."""
    rng = np.random.default_rng(5)
    turn = np.cumsum(rng.uniform(0.1, 0.5, size=60))
    vecs = np.stack([np.cos(turn / 8), np.sin(turn / 8), 0.1 * rng.normal(size=60)], 1)
    tile = pd.DataFrame({"rep": rng.permutation(60), "n": rng.integers(1, 4, 60), "vec": list(vecs), "cells": [[0, 1] if i % 3 else [1] for i in range(60)], "block": rng.integers(0, 2, 60), "cell": 1})
    for i, j in ((0, 0), (0, 1)):
        own = tile[tile["block"].isin([i, j])].assign(i=i, j=j)
        whole = E._links(own, 0.93)
        monkeypatch.setattr(E, "PART", 7)
        parts = E._links(own, 0.93)
        monkeypatch.undo()
        unit = {r.rep: (r.vec / np.linalg.norm(r.vec), r.n, r.block, 0 in r.cells) for r in own.itertuples()}
        links = {a: sum(n for b, (v, n, block, met) in unit.items() if a != b and (i == j or block != unit[a][2]) and not (met and unit[a][3]) and v @ unit[a][0] >= 0.93) for a in unit}
        assert dict(zip(whole["rep"], whole["links"], strict=True)) == {a: n for a, n in links.items() if n}
        assert whole.equals(parts)


def test_vectors_without_clusters_go_to_few_tasks(spark):
    """Nearly all of them lie near the borders of most cells, so each would be sent to every block of those."""
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(6000, 64)).astype(np.float32)
    vecs[:50] = vecs[50:100] + 0.01
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": vecs.tolist(), "label": 0}), "vec_id long, embedding array<float>, label int").cache()
    df.count()

    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.length()))

    before = shuffled()
    got = E.near_duplicates(df).where("n_links > 0").orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [(i, 1, i % 50, i < 50) for i in range(100)]
    assert shuffled() - before < 8 * vecs.nbytes


def test_negative_zero(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [-0.0, 1.0], 0), (3, [-0.0, -1.0], 0)]
    assert run(spark, rows) == brute(rows)
