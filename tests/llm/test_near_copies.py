import random

import corpus_pipeline as P
import numpy as np
from edge import DOCS, documents
from test_simhash import plain

from quietgrid.llm import near_copies as N


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    group = list(range(len(rows)))
    prints = [plain(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3 or jaccard(rows[i][1], rows[j][1]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return sorted(min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in set(group))


def test_similarity_is_exact(spark):
    a, b = "a b c d e f g h i j k l m", "a b c d e f g h i j k l n"  # 8 of 10 shingles
    c = "a b c d e f g h i j k n m"  # 7 of 11
    pairs = spark.createDataFrame([tuple(N.shingles(t).view("int64").tolist() for t in p) for p in ((a, b), (a, c))], "x array<long>, y array<long>")
    assert [r[0] for r in pairs.select(N.similar("x", "y")).collect()] == [True, False]
    assert len(N.shingles(None)) == len(N.shingles(" \n")) == 0 and len(N.shingles("one Two")) == 1 and np.array_equal(N.shingles("one Two"), N.shingles("ONE two"))


def test_stage_links_all_near_copies(spark):
    """Copies with scattered edits around the limit, far beyond 3 bits; chains; a large group with one bucket."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for n in range(20):
        base = [word() for _ in range(rng.randint(30, 300))]
        for k in range(60 if n == 0 else 6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45)) + k // 8):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own), "en", "s"))
    rng.shuffle(rows)
    stage = dict(P.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, documents(spark, rows), "unused").collect()) == brute(rows)


def test_edits_of_one_text_meet_few_others(spark):
    """Most edits have no near copy but the text itself, which is in no bucket with some; pairs that are tried don't grow with their square."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base), "en", "s")]
    for i in range(1, 160):
        own = list(base)
        for k in rng.sample(range(120), 1 + i % 7):
            own[k] = word()
        rows.append((i, " ".join(own), "en", "s"))
    tried = []
    similar = N._apart
    N._apart = lambda *a: tried.append(similar(*a)) or tried[0]
    try:
        assert sorted(r["doc_id"] for r in N.one_of_each(documents(spark, rows)).collect()) == brute(rows)
        assert tried[0].count() < 2 * len(rows)
    finally:
        N._apart = similar


def test_awkward_documents(spark):
    kept = N.one_of_each(documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == documents(spark).columns and ids.count(None) == 1 and N.one_of_each(documents(spark, [])).count() == 0
    assert sorted(i for i in ids if i is not None) == brute([d for d in DOCS if d[0] is not None])


def test_common_shingles_are_dealt_to_several_tasks(spark, monkeypatch):
    """With hardly a row of a shingle to a task, the same pairs are tried and the same rows stay. No leader links any beforehand."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(word() if rng.random() < 0.05 else w for w in base), "en", "s") for i in range(90)]
    found, leading, pairs = N._apart, N._leading, []
    monkeypatch.setattr(N, "_leading", lambda buckets: leading(buckets).where("false"))
    monkeypatch.setattr(N, "_apart", lambda *a: pairs.append(found(*a)) or pairs[-1])
    for deal in (N.DEAL, 2):
        monkeypatch.setattr(N, "DEAL", deal)
        assert sorted(r["doc_id"] for r in N.one_of_each(documents(spark, rows)).collect()) == brute(rows)
    plain_pairs, dealt_pairs = ({(r["a"], r["b"]) for r in p.collect()} for p in pairs)
    assert plain_pairs == dealt_pairs and plain_pairs
