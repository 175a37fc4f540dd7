import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from edge import DOCS, documents, untouched
from pyspark.sql import functions as F

from quietgrid.llm import langid as L


def test_awkward_documents(spark):
    got = L.identify(documents(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in DOCS)
    texts = {d[0]: d[1] for d in DOCS}
    for r in got:
        text = texts[r["doc_id"]]
        has = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] in ("en", "de", "fr")) if has else (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    assert L.identify(documents(spark, [])).count() == 0
    assert {r["lang_pred"] for r in L.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_labels_of_held_out_rows_teach_nothing(spark):
    df = documents(spark)
    other = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(str, L.identify(x).collect())) for x in (df, other))
    assert a == b


def test_filters_hold_what_sets_hold():
    rng = np.random.default_rng(0)
    for n in (3, 70):  # one word of bits, and two
        grams = {f"l{i:02d}": rng.integers(0, 1 << 63, 400).astype(np.uint64) for i in range(n)}
        model = L.Model.of(grams, None, slots=1 << 14)
        for i, name in enumerate(model.languages):
            bit = np.uint64(1 << i % 64)
            assert ((model.masks(grams[name])[:, i // 64] & bit) != 0).all()
            wrong = (model.masks(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))[:, i // 64] & bit) != 0
            assert abs(wrong.mean() - model.rates[i]) < 0.01


def test_counts_don_t_depend_on_chunks(monkeypatch):
    model = L.Model.of({"a": L._hashes(L.letters("the cat sat on the mat"), 3), "b": L._hashes(L.letters("die katze"), 3)}, None)
    text = "The cat, die Katze; " * 200
    whole = model.predict(text)
    monkeypatch.setattr(L, "CHUNK", 37)
    assert model.predict(text) == whole


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables aren't here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    kept = L.accepted(docs)
    assert kept.columns == docs.columns and kept.count() > 0.98 * docs.count()


def test_what_is_no_language_goes(spark):
    df = documents(spark)
    kept = L.accepted(df)
    assert kept.columns == df.columns and untouched(kept.collect())
    assert not {3, 4, 5, 10} & {r["doc_id"] for r in kept.collect()} and {1, 2, 9} <= {r["doc_id"] for r in kept.collect()}


def plain_grams(text):
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c for c in text or "")
    runs = "".join(c if c.isalpha() else " " for c in low).split()
    whole = f" {' '.join(runs)} " if runs else ""
    return [whole[i : i + n] for n in (2, 3, 4) for i in range(len(whole) - n + 1)]


def brute(rows, sample, most):
    """Every prediction from counts and sets; a gram's hash only breaks ties."""
    own = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            own.setdefault(lang, {})[xxhash.xxh64_intdigest(text.encode(), 42)] = text
    counts = {k: Counter(g for h in sorted(v)[:sample] for g in plain_grams(v[h])) for k, v in own.items()}
    total = {k: sum(c.values()) for k, c in counts.items()}
    hashed = lambda g: int(L._hashes(np.array([ord(c) for c in g], np.uint32), len(g)).view(np.int64)[0])
    sets = {}
    for k, c in counts.items():
        shared = [g for g in c if c[g] / total[k] >= L.SHARE * max(d[g] / total[j] for j, d in counts.items() if total[j])]
        sets[k] = set(sorted(shared, key=lambda g: (-c[g], hashed(g)))[:most])
    out = {}
    for i, text, _ in rows:
        grams = plain_grams(text)
        hits = {k: sum(g in s for g in grams) for k, s in sets.items()}
        if not grams or not sets:
            out[i] = ("und", 0.0)
        elif not sum(hits.values()):
            out[i] = (min(total, key=lambda k: (-total[k], k)), 0.0)
        else:
            best = min(hits, key=lambda k: (-hits[k], k))
            out[i] = (best, hits[best] / sum(hits.values()))
    return out


@pytest.mark.parametrize("sample, most", [(2000, 20_000), (5, 60)])
def test_predictions_equal_brute_force(spark, sample, most):
    rng = random.Random(8)
    alphabets = {"aa": "abcdefg", "bb": "efghijkl", "cc": "kéüßabc"}
    rows = []
    for i in range(200):
        lang = rng.choice(sorted(alphabets))
        text = " ".join("".join(rng.choices(alphabets[lang] + alphabets["bb"][:2], k=rng.randint(1, 7))) for _ in range(rng.randint(0, 30)))
        rows.append((i, text if i % 40 else None, lang if rng.random() < 0.9 else None))
    rows += [(300 + i, rows[1][1], rows[1][2]) for i in range(50)] + [(400, "12 34", "aa"), (401, "Zzz QQ", "bb"), (402, "İéÜ x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute(rows, sample, most)
    got = L.identify(docs.repartition(7), sample=sample, grams=most).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-5), r


def test_learning_does_not_gather_texts(spark):
    """The sample is chosen by hashes: no window sees texts, and the texts that are taken come by broadcast."""
    rows = documents(spark).where("lang is not null and text is not null").select("lang", "text").withColumn("_hash", F.xxhash64("text"))
    picked = L._picked(rows, 2, L.Scratch(spark, "test"))
    assert max(r["count"] for r in picked.groupBy("lang").count().collect()) == 2 and picked.columns == ["lang", "_hash"]
