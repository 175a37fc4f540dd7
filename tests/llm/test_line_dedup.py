import random

from edge import DOCS, documents

from quietgrid.llm import line_dedup as L


def brute(docs, least):
    sites, owner = {}, {}
    for i, text, _, site in docs:
        for line in (text or "").split("\n"):
            if key := line.strip(" "):
                sites.setdefault(key, set()).add(site)
                if i is not None:
                    owner[key] = min(owner.get(key, i), i)
    out = []
    for i, text, _, _ in docs:
        if text is None:
            out.append((i, 0, 0, None))
            continue
        kept, seen, lines, removed = [], set(), 0, 0
        for line in text.split("\n"):
            key = line.strip(" ")
            lines += bool(key)
            if key and len(sites[key]) >= least and (owner.get(key) != i or key in seen):
                removed += 1
                continue
            seen.add(key)
            kept.append(line)
        out.append((i, lines, removed, "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, docs, least):
    return sorted([(r["doc_id"], r["lines"], r["removed"], r["text"]) for r in L.dedup(documents(spark, docs), min_sites=least).collect()], key=str)


def test_awkward_documents(spark):
    for least in (1, 2, 3):
        assert run(spark, DOCS, least) == brute(DOCS, least)
    assert run(spark, [], 2) == []


def test_thresholds_are_exact(spark):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choices(lines, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(0, 9)) + ["", f" own {i} "]), "en", f"site{rng.randint(0, 40)}") for i in range(300)]
    for least in (2, 8, 20):
        assert run(spark, docs, least) == brute(docs, least)


def test_documents_of_nothing_else_go(spark):
    docs = [(i, "shared\nagain shared", "en", f"s{i}") for i in range(10)] + [(20, "shared\nown", "en", "s0"), (21, "", "en", "s0"), (22, None, "en", "s0")]
    df = documents(spark, docs)
    kept = L.strip(df)
    assert kept.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {0: ("shared\nagain shared", 19), 20: ("own", 3), 21: ("", 0), 22: (None, None)}


def test_null_ids_and_repeated_rows_are_cleaned_each(spark):
    docs = [(None, f"shared\nown {i}\nshared", "en", f"s{i}") for i in range(9)] + [(5, "shared\nshared\nx", "en", "s1")] * 2 + [(5, "y\nshared", "en", "s2"), (6, "shared\nshared\nx", "en", "s1")]
    for least in (2, 9):
        assert run(spark, docs, least) == brute(docs, least)


def test_many_removed_lines_of_one_document(spark):
    lines = [f"line {k % 4000}" for k in range(8000)]
    docs = [(i, "\n".join(lines), "en", f"s{i}") for i in range(3)]
    assert run(spark, docs, 2) == brute(docs, 2)
