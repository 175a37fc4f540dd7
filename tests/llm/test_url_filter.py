import re

import pytest

from quietgrid.llm import url_filter as U

URLS = [
    None, "", "no scheme/casino", "http://", "https://Example.ORG/es/x", "https://example.org/en/12", "https://a.example.org/en/2", "http://example.org", "http://example.org?x=/es/", "http://notexample.org/es/", "https://x.com/fr/p", "https://x.com/de/p",
    "https://CASINO.net/a", "https://casinos.net/a", "https://x.net/free?bet#win", "https://x.net/free?free#freedom", "http://x.net/a#://org/", "://org/", "https://é.net/İ/xxx", "http://x.net/line\nbreak/porn", "http://x.net/%70or%6E", "http://x.net/%25porn%2570orn", "http://x.net/a%2", "http://x.net/%C3porn", "http://x.net/best/online/sale", "http://x.net/best/online/sale-vip", "http://x.net/BEST/free+click", "http://x.net/%%70orn", "https://" + "a" * 100_000 + ".net/spam",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = None
    for verdict, rule in U.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    low, i = "", 0
    while i < len(url or ""):
        if url[i] == "%" and re.fullmatch("[2-7][0-9a-fA-F]", url[i + 1 : i + 3]):
            low, i = low + chr(int(url[i + 1 : i + 3], 16)), i + 3
        else:
            low, i = low + url[i], i + 1
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in low)
    found = {t for t in U.VOCABULARY if t in low and re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}
    bad = any(U.VOCABULARY[t] >= 1 for t in found) or sum(U.VOCABULARY[t] for t in found) >= 1
    return host, path, best and best[1], best[0] if best else ("block" if bad else "allow")


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(0, None, "h", "v"), (None, URLS[4], "h", "v")], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)} | {None: plain(URLS[4])}
    assert U.judge(df).count() == len(URLS) + 2 and U.judge(df.limit(0)).count() == 0


def test_hits():
    terms = frozenset(U.VOCABULARY.items())
    got = [U.hits(t, terms) for t in ("a.xxx/xxx", "xxxx", "free-free", "", "free.best")]
    assert got == [(2, 0, 0.0), (0, 0, 0.0), (0, 1, 0.5), (0, 0, 0.0), (0, 2, 0.75)]
    assert U.hits("xxx", frozenset()) == (0, 0, 0.0)


def test_a_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Foo-Bar", 2.0), ("foo-bar", 0.1), ("bar", 0.6), ("x y", 0.5), (None, 1.0), ("", 1.0), ("z", None)], "term string, weight double")
    found = U.read_vocabulary(terms)
    assert found == {"foo-bar": 2.0, "bar": 0.6, "x y": 0.5}
    pages = spark.createDataFrame([(1, "http://a/foo-bar"), (2, "http://a/xfoo-bar"), (3, "http://bar/x%20y"), (4, "http://bar/bar"), (5, "http://a.xxx/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in U.judge(pages, vocabulary=found).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert sorted(con.execute(U.SQL).fetchall()) == sorted(tuple(r) for r in U.judge(df).collect())
