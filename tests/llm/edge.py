"""Small tables with every awkward case."""

from __future__ import annotations

LONG = "lorem ipsum dolor " * 30_000
DOCS = [
    (1, "The cat sat on the mat.\nSecond line here", "en", "a"),
    (2, "the CAT sat on the mat.\nSecond line here", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n\x0b ", "de", None),
    (6, "one", "de", None),
    (7, "one", "de", "c"),
    (7, "one", "de", "c"),
    (8, "deux mots é̀   İ \x1c x", "fr", "c"),
    (9, LONG, "en", "a"),
    (None, "nobody's text", "en", "a"),
    (None, "nobody's text", None, None),
    (10, "12 !? 3", None, ""),
]
#: Names that operators and stages use inside, with values that would show if they came through.
INSIDE = ["_row", "_id", "_doc", "_fp", "_text", "_hash", "_n", "_group", "_best", "_bit", "_key", "_at", "_line", "_lines", "_site", "_own", "_owner", "_gone", "_removed", "_clean", "_drop", "_once", "_keys", "_lang", "_limit", "_draw", "_order", "_source", "_shard", "_cut", "_copy", "_words", "component_id", "held_out", "nth"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank string, cell int, score string, part string, " + ", ".join(f"{n} string" for n in INSIDE)


def documents(spark, rows=DOCS):
    """With columns whose names operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 5, "r", 1, "s", "p", *(f"own {n}" for n in INSIDE)) for r in rows], SCHEMA).repartition(3)


def untouched(rows):
    """Whether all those columns came back as they were."""
    return all(r[n] == f"own {n}" for r in rows for n in INSIDE)
