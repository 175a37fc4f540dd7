import hashlib
import random
import re
import tracemalloc

from edge import DOCS, INSIDE, documents
from pyspark.sql import functions as F

from quietgrid.llm import fim as M

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EXTRA = [(20, "a<P>b c d", "en", "a"), (21, "<S><M>", "en", "a"), (22, "  lead and trail \n ", "en", "a"), (23, "< P > << S <S M> x", "en", "a"), (24, "\x00 \x1c  wide　 spaces", "en", "a"), (2**62, "big id here", "en", "a"), (-5, "negative id here too", "en", "a")]


def brute(i, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_round_trip(spark):
    rng = random.Random(5)
    docs = [*DOCS, *EXTRA, *((100 + i, "".join(rng.choices(["a", "é", "<", "S>", ">", "P", "M", " ", "\n", "\t\t", "日本"], k=rng.randint(0, 60))), "en", "a") for i in range(400))]
    rows = M.transform(documents(spark, docs)).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    got = sorted([(r["row"]["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows], key=str)
    assert got == sorted([brute(i, t) for i, t, *_ in docs], key=str)
    assert all(r["back"] == (r["row"]["text"] or "") for r in rows)
    assert all(r["row"][n] == f"own {n}" for r in rows for n in INSIDE)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert M.transform(documents(spark, [])).count() == 0


def test_digests(spark):
    rows = {(r["doc_id"], r["restored_sha256"]): r for r in M.digests(documents(spark, [*DOCS, *EXTRA])).collect()}
    for i, text, *_ in [*DOCS, *EXTRA]:
        n, form, p, m, out = brute(i, text)[1:]
        r = rows[i, hashlib.sha256((text or "").encode()).hexdigest()]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())


def test_every_rank_of_a_text():
    text = " a bc\n\nd  é \t"
    units = UNITS.findall(text)
    assert M.count(text) == len(units) == 5
    for a in range(6):
        for b in range(a, 6):
            assert M.ends(text, a, b) == (len("".join(units[:a])), len("".join(units[:b])))


def test_memory_does_not_grow_with_units():
    def peak(text):
        n = M.count(text)
        tracemalloc.start()
        M.count(text), M.ends(text, n // 3, n)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak("a " * 400_000) < 20_000
