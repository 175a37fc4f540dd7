import random
from collections import defaultdict

import numpy as np
import pytest
from edge import DOCS, LONG, documents

from quietgrid.llm import suffix_dedup as X


def brute(docs, least):
    seen, words = defaultdict(set), []
    for n, d in enumerate(docs):
        words.append((d[1] or "").encode().lower().split())
        for a in range(len(words[n]) - least + 1):
            seen[tuple(words[n][a : a + least])].add(n)
    out = []
    for d, w in zip(docs, words, strict=True):
        spans = []
        for a in range(len(w) - least + 1):
            if len(seen[tuple(w[a : a + least])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + least
                else:
                    spans.append([a, a + least])
        out += [(d[0], *s) for s in spans]
    return sorted(out, key=str)


def run(spark, docs, **options):
    got = X.repeated_passages(documents(spark, docs), **options).collect()
    assert all(r["n_words"] == r["end_word"] - r["start_word"] for r in got)
    return sorted([(r["doc_id"], r["start_word"], r["end_word"]) for r in got], key=str)


def texts(rng, n, passages, vocabulary=400):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(length)] for length in passages]
    docs = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += [word() for _ in range(rng.randint(0, 70))]
            if rng.random() < 0.6:
                own += rng.choice(shared)
        docs.append((i, " ".join(own), "en", "s"))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = texts(rng, 60, [49, 50, 51, 60, 80, 130, 300])
    assert run(spark, docs, block=40) == brute(docs, 50)


@pytest.mark.parametrize("block", [2, 100_000])
def test_edited_copies_hide_nothing(spark, block):
    """Copies with edits share long right sides with each other and passages with third documents."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 53, 56, 60, 70, 90)]
    docs = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(80, 300))]
        for p in rng.sample(passages, 2):
            q = rng.randrange(len(base))
            base[q:q] = p
        for _ in range(8):
            own = list(base)
            for _ in range(len(own) // rng.choice([15, 25, 40, 80])):
                own[rng.randrange(len(own))] = word()
            docs.append((len(docs), " ".join(own), "en", "s"))
    for _ in range(10):
        own = [w for p in rng.sample(passages, 3) for w in [word() for _ in range(rng.randint(0, 30))] + p[rng.randint(0, 3) :]]
        docs.append((len(docs), " ".join(own), "en", "s"))
    assert run(spark, docs, block=block) == brute(docs, 50)


def test_hot_passage_and_copies(spark):
    rng = random.Random(9)
    docs = texts(rng, 120, [70])
    docs += [(1000 + i, docs[5][1], "en", "s") for i in range(40)]
    # a passage that stands twice in a document, and once in another
    twice = [f"t{i}" for i in range(55)]
    docs += [(2000, " ".join([*twice, "a", "b", *twice]), "en", "s"), (2001, " ".join(twice), "en", "s"), (2002, " ".join([*(f"u{i}" for i in range(55))] * 2), "en", "s")]
    assert run(spark, docs, block=3, slot_log=8, filter_log=6) == run(spark, docs) == brute(docs, 50)


def test_awkward_documents(spark):
    docs = [*DOCS, (30, LONG + " end", "en", "s"), (None, " ".join(f"q{i}" for i in range(60)), "en", "s"), (31, "x " + " ".join(f"Q{i}" for i in range(60)), "en", "s")]
    got = run(spark, docs)
    assert got == brute(docs, 50)
    assert (None, 0, 60) in got and (31, 1, 61) in got
    assert run(spark, []) == []


def test_hashes_don_t_depend_on_place():
    a = X.word_hashes(b"  One two\tthree\nfour ")
    b = X.word_hashes(b"zero one TWO three four")
    np.testing.assert_array_equal(a, b[1:])
    assert len(X.word_hashes(b"")) == 0 and len(X.word_hashes(b" \n")) == 0
