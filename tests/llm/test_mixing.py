import re

import pytest
from edge import DOCS, documents

from quietgrid.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def rows(n=300):
    import random

    rng = random.Random(2)
    return [(i, " ".join("w" for _ in range(int(rng.paretovariate(0.8)) % 500)), "en", rng.choice("aaaaaabcdefgh") if i % 17 else None) for i in range(n)]


@pytest.mark.parametrize("docs, shard", [(DOCS, 1 << 20), (DOCS, 60), (rows(), 1 << 20), (rows(), 60), (rows(), 300), ([(1, "a b", "en", "only")], 60), ([(1, None, None, None), (2, "", "en", "x")], 60)])
def test_targets_are_met(spark, docs, shard):
    got = M.mix(documents(spark, docs), shard_words=shard).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d[0]), size(d[1])) for d in docs)
    sizes = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + size(d[1])
    want = targets(sizes)
    source = {(d[0], size(d[1])): d[3] for d in docs}
    if len(source) == len(docs):
        taken, shards = {}, {}
        for r in got:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[s] = taken.get(s, 0) + r["taken"]
            shards[s] = max(1, sizes[s] // shard + 1)
        for s, n in taken.items():
            assert abs(n - want[s]) <= M.BLOCK * (shards[s] + 1)
    again = M.mix(documents(spark, docs).repartition(5), shard_words=shard).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_highest_quotients(spark):
    claims = {"a": 50.3, "b": 20.1, "c": 20.1, "d": 9.5, "e": 0.2}
    most = {"a": 1000.0, "b": 1000.0, "c": 1000.0, "d": 3.0, "e": 1000.0}
    for blocks in (0, 1, 7, 20, 101):
        df = spark.createDataFrame([(s, claims[s], most[s], float(blocks)) for s in claims], "s string, t double, m double, b double")
        got = {r["s"]: r["seats"] for r in M._seats(df, [], ["s"], "b").collect()}
        ranked = sorted((-claims[s] / (2 * k + 1), s) for s in claims for k in range(int(min(most[s], blocks))))
        want = dict.fromkeys(claims, 0)
        for _, s in ranked[:blocks]:
            want[s] += 1
        assert got == want


def test_highest_quotients_over_all_shards(spark):
    """Whatever number of shards a source has, its blocks go to the highest quotients over all of them."""
    import random

    rng = random.Random(3)
    shards, blocks = [], {"a": 700.0, "b": 3.0, None: 41.0, "none": 0.0, "all": 1e9}
    for s, n in (("a", 1500), ("b", 2), (None, 30), ("none", 3), ("all", 4)):
        shards += [(s, k, float(rng.choice([0, 1, 5, 5, 60, 999, 10**6])), float(rng.randint(0, 30)), blocks[s]) for k in range(n)]
    df = spark.createDataFrame(shards, "source string, _shard long, t double, m double, _blocks double").repartition(3)
    got = {(r["_s"], r["_k"]): r["_seats"] for r in M._shares(df, M.Scratch(spark, "shares")).collect()}
    want = {x[:2]: 0 for x in shards}
    for s, most in blocks.items():
        ranked = sorted((-t / (2 * k + 1), shard) for own, shard, t, m, _ in shards if own == s for k in range(int(m)) if t > 0)
        for _, shard in ranked[: int(most)]:
            want[s, shard] += 1
    assert {k: v for k, v in got.items() if dict((x[:2], x[2]) for x in shards)[k] > 0} == {k: v for k, v in want.items() if dict((x[:2], x[2]) for x in shards)[k] > 0}


def test_the_mix_itself(spark):
    docs = rows(120)
    df = documents(spark, docs)
    mixed = M.materialise(df)
    assert mixed.columns == df.columns
    taken = {r["doc_id"]: r["taken"] for r in M.mix(df).collect()}
    got, text = {}, {d[0]: d[1] for d in docs}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + size(r["text"])
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in taken.items() if v}
    assert M.materialise(documents(spark, [])).count() == 0 and M.mix(documents(spark, [])).count() == 0
