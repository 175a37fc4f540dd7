import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from edge import DOCS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quietgrid.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_encode_as_the_tokenizer_does():
    rng = random.Random(1)
    parts = ["abc", "XYZ", "'s", "'ll", "t", " ", "\n", "\x1c", "\xa0", "é", "é", "漢", "1", "23", "!?", "<|endoftext|>", "<", "-", "_", "😀", "\x0b", "İ", "ß", "̸", "क़", "K", "it", ".", ","]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert np.frombuffer(P.encode([text.encode()], PATH)[0], "<u4").tolist() == ids(text)[:-1], text


def check(rows, docs, capacity):
    rows = [r.asDict() for r in rows]
    pieces = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for d in docs:
        own = np.array(ids(d[1]), "<u4")
        want += [(str(d[0]), i, s, len(own[s : s + capacity]), zlib.crc32(own[s : s + capacity].tobytes())) for i, s in enumerate(range(0, len(own), capacity))]
    assert pieces == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents(spark, capacity):
    bins, least = check(P.pack(documents(spark), PATH, capacity).collect(), DOCS, capacity)
    assert bins <= least + 1
    assert P.pack(documents(spark, []), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12))
def test_plan_uses_every_piece_once(histogram):
    left = dict(histogram)
    for uses, bins in P.plan(histogram, 30):
        assert bins >= 1 and sum(k * n for k, n in uses) <= 30
        for k, n in uses:
            left[k] -= n * bins
    assert not any(left.values())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    got = P.fullest(counts, room)
    assert sum(k * n for k, n in got) == max(sums) and all(n <= counts[k] for k, n in got)
