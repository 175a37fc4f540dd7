import math
import random
import re
from collections import Counter

import numpy as np
from edge import DOCS, documents

from quietgrid.llm import wand as W
from quietgrid.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n // total
            s = sum(q * w[t] * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, q in asked.items() if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k, **options):
    scratch = Scratch(spark, "wandtest")
    table = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, _item string, term string")
    block = {"block": options["block"]} if "block" in options else {}
    return sorted([tuple(r) for r in W.search(W.build(documents(spark, docs), scratch, **options), table, k, **block).collect()], key=str)


def corpus(rng, n):
    names = [f"t{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    return [(i * 7 % 1009, " ".join(rng.choices(names, weights, k=rng.randint(0, 50))), "en", "a") for i in range(n)]


ITEMS = [(1, "The cat, the CAT"), (2, None), (3, ""), (4, "one text lorem"), (5, "deux é̀ İ x nobody"), (6, "unknown terms only"), (6, "one lorem ipsum")]


def test_awkward_documents(spark):
    for docs in (DOCS, [], [(1, "!", "en", "a")]):
        assert run(spark, docs, ITEMS, 3) == brute(docs, ITEMS, 3)
    assert run(spark, DOCS, [], 3) == []


def test_equals_brute_force_over_blocks_and_shards(spark):
    rng = random.Random(6)
    docs = corpus(rng, 500)
    items = [(i, " ".join(rng.choices([f"T{j}" for j in range(125)], k=rng.randint(1, 12)))) for i in range(25)]
    want = brute(docs, items, 10)
    for options in ({}, {"block": 4}, {"block": 3, "shard": 300}):
        assert run(spark, docs, items, 10, **options) == want


def test_items_in_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(W, "ITEM_TERMS", 5)
    rng = random.Random(7)
    docs, items = corpus(rng, 60), [(i, f"t{i} t{i + 1} t3") for i in range(6)]
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_blocks_are_packed_and_come_back():
    rng = np.random.default_rng(8)
    for top in (2, 300, 70_000, 2**33):
        ordinals = np.cumsum(rng.integers(1, top, 50))
        tf = rng.integers(1, top, 50)
        starts = np.arange(0, 50, 8)
        before = np.append(-1, ordinals[starts[1:] - 1])
        packed, ends = W.pack(ordinals, tf, np.repeat(np.arange(7), 8)[:50], starts, before)
        for i, s in enumerate(starts):
            n = min(8, 50 - s)
            docs, counts = W.unpack(packed.tobytes(), int(ends[i - 1]) if i else 0, n, int(before[i]))
            assert (docs == ordinals[s : s + n]).all() and (counts == tf[s : s + n]).all()


def test_blocks_under_the_threshold_stay_packed():
    """A rare term in few documents and a common one in all: of the common one's blocks few are looked into."""
    norm = np.full(10_000, 100)

    def posting_list(docs, tf):
        docs, tf = np.asarray(docs), np.asarray(tf)
        starts = np.arange(0, len(docs), 128)
        lasts = docs[np.append(starts[1:], len(docs)) - 1]
        packed, ends = W.pack(docs, tf, np.repeat(np.arange(len(starts)), 128)[: len(docs)], starts, np.append(-1, lasts[:-1]))
        return W._List(len(docs), lasts, np.maximum.reduceat(W.impacts(tf, norm[docs]), starts), ends, packed.tobytes(), norm, 128)

    common, rare = posting_list(range(10_000), np.ones(10_000, np.int64)), posting_list(range(0, 2000, 100), np.full(20, 3))
    hits, looked = W.best([(common, 1), (rare, 50)], 20)
    assert [d for _, d in hits] == list(range(0, 2000, 100))
    assert looked < 30 < len(common.lasts)
    assert len(common.unpacked) < 30


def test_long_texts_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(W, "SLICE", 5)
    text = "Aa bbb-cc dddddddddddd e é1  "
    assert [t.decode() for part in W.term_lists(text) for t in part] == terms(text)
