import random

import xxhash
from edge import DOCS, documents

from quietgrid.llm import simhash as S
from quietgrid.llm.common import Scratch


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain(r[1]) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] > group[j]:
                    group[i], changed = group[j], True
    return sorted([(r[0], f"{f:016x}", min((s[0] for s, h in zip(rows, group, strict=True) if h == g and s[0] is not None), default=None)) for r, f, g in zip(rows, fps, group, strict=True)], key=str)


def test_awkward_documents(spark):
    got = sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(documents(spark)).collect()], key=str)
    assert got == brute(DOCS)
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_near_copies_and_chains(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(400)]
        for k in range(5):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(400)] = word()
            rows.append((len(rows), " ".join(own), "en", "s"))
    rng.shuffle(rows)
    got = sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(documents(spark, rows)).collect()], key=str)
    assert got == brute(rows)
    assert len({c for *_, c in got}) < len(rows)


def test_links_are_exact(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed + signed[:9]], "_fp long")
    got = sorted((r["a"], r["b"]) for r in S.links(table).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want
    some = {(r["a"], r["b"]) for r in S.joining(table, Scratch(spark, "test")).collect()}
    assert some <= set(want)
    assert joined(some) == joined(want)


def joined(pairs):
    group = {}
    for a, b in pairs:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                group[k] = x
    return {frozenset(g) for g in group.values()}


def test_a_large_group_of_near_copies_has_few_links(spark):
    """All fingerprints at one bit or none from a common one: 65 of them have 2080 links."""
    table = spark.createDataFrame([(0,)] + [(1 << b if b < 63 else -(1 << 63),) for b in range(64)], "_fp long")
    assert S.links(table).count() == 65 * 64 // 2
    some = S.joining(table, Scratch(spark, "test")).collect()
    assert len(some) < 200 and len(joined((r["a"], r["b"]) for r in some)) == 1


def test_one_of_each(spark):
    kept = S.one_of_each(documents(spark))
    want = brute(DOCS)
    assert kept.columns == documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for *_, c in want if c is not None})
    assert ids.count(None) == 1 and S.one_of_each(documents(spark, [])).count() == 0
