import math
from fractions import Fraction

import numpy as np
import pytest

from quietgrid.llm import mtree as M

SCHEMA = "vec_id long, embedding array<double>, pivot string, dim string, score int, times string, query string"


def brute(rows, every, k):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [math.floor(Fraction(x) * 1024) for x in v]))
    out = []
    for q, x in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        inner = lambda y, x=x: min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(1 << 63)), (1 << 63) - 1)
        scored = sorted((-inner(y), c) for c, y in ok if c != q and len(y) == len(x))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "p", "d", 1, "t", "q") for r in rows], SCHEMA)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in M.top_k(df, **options).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_with_ties_and_shards(spark, seed):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(7, 5))
    rows = [(i, [float(v) for v in np.round(heads[i % 7] + rng.normal(scale=0.2, size=5), 1)]) for i in range(400)]
    assert run(spark, rows, every=20, shard=40, pivots=9, block=4) == brute(rows, 20, 10)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (10, [1.0, 2.0]), (20, None), (30, [float("nan"), 1.0]), (40, [None, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [0.0, 0.0]), (7, [3.0]), (50, [2.0]), (None, [1.0, 1.0]), (8, [-1.0, 5.0]), (9, [float("inf"), 0.0])]
    rows += [(100 + i, [0.5, 0.5]) for i in range(30)]
    assert run(spark, rows, every=10) == brute(rows, 10, 10)
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [1e6, 3e9, 1.7e308], ids=["products of a long", "beyond a long", "largest"])
def test_large_components(spark, size):
    """Scores are exact where doubles aren't, and no finite vector is left out."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) * size for v in rng.uniform(-1, 1, 64)]) for i in range(120)]
    rows += [(200 + i, [float(v) for v in rng.uniform(-1, 1, 64)]) for i in range(40)] + rows[7:9]
    assert run(spark, rows, every=20, shard=50, pivots=5) == brute(rows, 20, 10)


def test_sql_agrees(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.uniform(-1e6, 1e6, 64)]) for i in range(0, 500, 5)]
    rows += rows[3:6] + rows[:1] + [(400, [float(v) for v in rng.uniform(-9, 9, 64)]), (None, [1.0] * 64), (7, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(M.SQL).fetchall())
    assert want == brute(rows, 100, 10) == run(spark, rows)


def test_bounds_leave_computations_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c * 4000, 30, (500, 4)) for c in range(8)]).round()
    space = M.Space(4, 2.0**15, float((x**2).sum(1).max()) / 2.0**30, 1)
    tree = M.Tree(M.build(x, np.arange(len(x)), np.ones(len(x), np.int64), space, leaf=32, fan=8), space)
    for i in range(0, len(x), 97):
        got = sorted(tree.search(x[i], None, 10, []), reverse=True)
        scores = (x @ x[i]).astype(int)
        assert got == sorted(((int(s), -j, 1) for j, s in enumerate(scores)), reverse=True)[:10]
    assert tree.computed < 0.6 * len(x) * len(range(0, len(x), 97))
