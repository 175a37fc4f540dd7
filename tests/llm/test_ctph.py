import hashlib
import random
import zlib

import pytest
from edge import DOCS, documents

from quietgrid.llm import ctph as C

WORDS = [f"word{i}" for i in range(500)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def slow(text):
    """The fingerprint, code point by code point."""

    def rolled(i):
        value, factor = 0, 1
        for back in range(min(C.WINDOW, i + 1)):
            value = (value + (ord(text[i - back]) + 1) * factor) % 2**32
            factor = factor * 0x01000193 % 2**32
        value ^= value >> 15
        value = value * 0x85EBCA6B % 2**32
        return value ^ value >> 13

    def symbols(block):
        out, start, ends = "", 0, [i + 1 for i in range(len(text)) if rolled(i) % block == block - 1]
        for end in [*ends[: C.MOST - 1], len(text)]:
            if end > start:
                out += C._PAIRS[zlib.crc32(text[start:end].encode()) & 0xFFF]
            start = end
        return out, len(ends)

    block = 3
    while block * 64 < len(text):
        block *= 2
    while block > 3 and symbols(block)[1] < 16:
        block //= 2
    return f"{block}:{symbols(block)[0]}:{symbols(2 * block)[0]}"


def slow_likeness(x, y):
    """1 - edit distance / summed lengths, by the usual table."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, before = [i], row
        for j, b in enumerate(y, 1):
            row.append(before[j - 1] if a == b else 1 + min(before[j], row[j - 1]))
    return 1 - row[-1] / (len(x) + len(y))


@pytest.mark.parametrize("at_once", [C.SLICE, 10])
def test_fingerprints_are_those_of_the_slow_way(monkeypatch, at_once):
    monkeypatch.setattr(C, "SLICE", at_once)
    rng = random.Random(1)
    for text in ["", "a", "ab", "abcdefg", "é" * 30, "日本語の文" * 40, "aaaa" * 400, "lorem ipsum dolor " * 60, *(prose(rng, n) for n in (1, 5, 30, 200))]:
        assert C.fingerprint(text) == slow(text), text[:20]


def test_likeness_is_an_edit_distance():
    rng = random.Random(2)
    split = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    for _ in range(60):
        a, b = ("".join(rng.choices(C._PAIRS[:6], k=rng.randint(0, 40))) for _ in "ab")
        c, d = ("".join(rng.choices(C._PAIRS[:6], k=rng.randint(1, 20))) for _ in "cd")
        for f, g, x, y in ((f"6:{a}:{c}", f"6:{b}:{d}", a, b), (f"6:{a}:{c}", f"12:{b}:{d}", c, b), (f"12:{a}:{c}", f"6:{b}:{d}", a, d)):
            if f != g and (x or y):
                assert C.likeness(f, g) == pytest.approx(slow_likeness(split(x), split(y)))
        assert C.likeness(f"3:{a}:{c}", f"12:{b}:{d}") == 0 and C.likeness(f"6:{a}:{c}", f"6:{a}:{c}") == 1
    assert C.likeness("3::", "3::") == 1 and C.likeness("3::", "3:AA:AB") == 0


def test_edits_stay_near_and_strangers_far():
    rng = random.Random(3)
    edits, strangers, halves = [], [], []
    for _ in range(60):
        text, other = prose(rng, rng.randint(100, 3000)), prose(rng, rng.randint(100, 3000))
        at = rng.randint(0, len(text))
        edits.append(C.likeness(C.fingerprint(text), C.fingerprint(text[:at] + " new words " + text[at:])))
        halves.append(C.likeness(C.fingerprint(text), C.fingerprint(C.edited(text, other))))
        strangers.append(C.likeness(C.fingerprint(text), C.fingerprint(other)))
    assert min(edits) > 0.8 and min(halves) > 0.25 and max(strangers) < 0.2


def brute(docs):
    rows = sorted(((i, t or "") for i, t, *_ in docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        changed = C.edited(t, other)
        a, b, c = (C.fingerprint(x) for x in (t, changed, other))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, C.likeness(a, b), C.likeness(a, c)))
    return sorted(out, key=str)


def run(spark, docs):
    return sorted([tuple(r) for r in C.against_next(documents(spark, docs)).collect()], key=str)


def test_awkward_documents(spark):
    unique = [d for k, d in enumerate(DOCS) if d[0] is not None and d not in DOCS[:k]]
    assert run(spark, unique) == brute(unique)
    twice = run(spark, DOCS)
    assert len(twice) == len(DOCS) and {r[:2] for r in twice} == {(i, len(t or "")) for i, t, *_ in DOCS}
    assert sorted(r[3] for r in twice) == sorted(C.fingerprint(t or "") for _, t, *_ in DOCS)
    assert run(spark, []) == [] and run(spark, DOCS[:1]) == brute(DOCS[:1])
    same = [(5, "one and the same text", "en", "a")] * 40  # one key has all rows
    assert run(spark, same) == brute(same)


def test_neighbours_meet_across_tasks(spark):
    rng = random.Random(4)
    docs = [(i * 3, prose(rng, rng.randint(0, 60)), "en", "a") for i in range(200)]
    assert run(spark, docs) == brute(docs)


def test_columns(spark):
    rows = C.fingerprints(documents(spark)).collect()
    assert [r["fingerprint"] for r in rows] == [C.fingerprint(r["text"] or "") for r in rows] and all(r["_key"] == "own _key" for r in rows)
    pairs = spark.createDataFrame([("3:AA:", "3:AA:"), (None, "3::")], "a string, b string")
    assert [r[0] for r in pairs.select(C.compare(pairs["a"], pairs["b"])).collect()] == [1.0, None]
