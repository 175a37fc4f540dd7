"""Kneser-Ney models against a model of dictionaries."""

import math
import re
import uuid
from collections import Counter, defaultdict

import pytest

from quietgrid.operators import ngrams as N

ONE = ["the cat sat on the mat", "The cat ran", None, "a cat, a mat!", "", "the the the"]
OTHER = ["dogs ran on the road", "a dog sat", "42 !"]
RECORDS = [(1, "the cat ran on the road"), (2, None), (3, "zebra"), (4, "the the the the mat"), (5, "a dog sat on a dog")]


class Model:
    def __init__(self, texts, order, size):
        self.order, self.size, self.tables = order, size, []
        grams = Counter()
        for t in texts:
            w = ["<s>"] * (order - 1) + re.findall("[a-z]+", (t or "").lower()) + ["</s>"]
            grams.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
        for _ in range(order):
            self.tables.insert(0, grams)
            grams = Counter(g[1:] for g in grams)
        self.after = [defaultdict(list) for _ in range(order)]
        for k, table in enumerate(self.tables):
            for g, c in table.items():
                self.after[k][g[:-1]].append(c)

    def p(self, gram):
        out = 1 / (self.size + 1)
        for k in range(self.order):
            g = gram[self.order - 1 - k :]
            if counts := self.after[k].get(g[:-1]):
                out = (max(self.tables[k][g] - 0.75, 0) + 0.75 * len(counts) * out) / sum(counts)
        return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_log_odds(spark, order):
    known = {w for t in ONE + OTHER for w in [*re.findall("[a-z]+", (t or "").lower()), "</s>"]}
    one, other = (Model(t, order, len(known)) for t in (ONE, OTHER))
    tables = [spark.createDataFrame([(t,) for t in texts], "body string") for texts in (ONE, OTHER)]
    records = spark.createDataFrame(RECORDS, "id long, body string")
    got = {r["id"]: (r["words"], r["score"]) for r in N.log_odds(records, *tables, ["id"], "body", order).collect()}
    for i, text in RECORDS:
        w = ["<s>"] * (order - 1) + re.findall("[a-z]+", (text or "").lower()) + ["</s>"]
        odds = [math.log(one.p(tuple(w[k - order + 1 : k + 1])) / other.p(tuple(w[k - order + 1 : k + 1]))) for k in range(order - 1, len(w))]
        assert got[i][0] == len(odds) - 1 and got[i][1] == pytest.approx(sum(odds) / len(odds))
    seen = {g[:-1] for m in (one,) for g in m.tables[-1]}
    for ctx in seen:  # shares of a context sum to 1, with one share for unknown words
        assert sum(one.p((*ctx, w)) for w in [*known, "unknown"]) == pytest.approx(1)


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "body string")
    some = spark.createDataFrame([("a b",)], "body string")
    records = spark.createDataFrame([(1, "a b c")], "id long, body string")
    assert N.log_odds(records, none, none, ["id"], "body").first()["score"] == 0
    assert N.log_odds(records, some, none, ["id"], "body").first()["score"] > 0 > N.log_odds(records, none, some, ["id"], "body").first()["score"]
    assert N.log_odds(records.where("false"), some, none, ["id"], "body").count() == 0


def test_texts_are_read_once(spark, tmp_path):
    """Not for each table and order that their counts go into, nor at a cost by the square of their words."""

    def noted(batches):
        for b in batches:
            (tmp_path / uuid.uuid4().hex).write_text(str(len(b)))
            yield b

    one, other = (spark.createDataFrame([(t,) for t in texts], "body string").mapInPandas(noted, "body string") for texts in (ONE, OTHER))
    records = spark.createDataFrame(RECORDS, "id long, body string").mapInPandas(noted, "id long, body string")
    assert N.log_odds(records, one, other, ["id"], "body", 3).count() == len(RECORDS)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == len(ONE) + len(OTHER) + len(RECORDS)
