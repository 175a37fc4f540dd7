"""URL filters: host and path rules first, then a weighted vocabulary matched by an Aho-Corasick automaton.

The automaton finds every term of the vocabulary in one pass over the URL, in which escapes of ASCII characters have been
decoded once and A-Z put in lower case. A hit counts if neither neighbour is a letter or digit of ASCII. A term that weighs
LIMIT or more is strict, others are soft: one strict hit, or distinct soft terms that weigh LIMIT together, block a URL that
no rule decides. The vocabulary below is a default; read_vocabulary() takes another from a table.
"""

from __future__ import annotations

import math
import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. (verdict, rule): the rule is a host and a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The weight that blocks.
LIMIT = 1.0
# The default vocabulary. Strict terms weigh 1, soft ones a half, weak ones a quarter.
STRICT = """
adult adultdating adultfriendfinder bdsm bestiality bukkake camgirl camgirls camsex casino casinos cialis creampie darknet deepfakes
dildo erotic erotica escort escorts exploitkit fetish fuck gangbang gore hardcoresex hentai incest jailbait keygen keylogger levitra
malware masturbation milf nsfw nude nudes onlyfans orgy phishing porn porno pornhub pornography pornos pornstar pornstars rapidgator
ransomware roulette sexcam sexcams sexchat sexshop sextoys sexvideos shemale softcore spam spyware sportsbook strip striptease
swingers threesome torrent torrents trojan twink upskirt viagra voyeur warez webcamsex whore xhamster xnxx xvideos xxx
""".split()
SOFT = """
ads adserver affiliate bet bets betting bingo bonus cheap clickbait coupon coupons crack cracked cracks dating deal deals discount doubleclick
farm followers forex free freebies gambling girls hack hacks hookup hot jackpot keto lesbian loan loans lottery mature naked offer offers
payday pharmacy pills pirate poker popup popups promo proxy referral replica serial sex sexy singles slot slots steroids teen teens track
tracker tracking unblocked wagering watches weightloss win winner winners
""".split()
WEAK = """
best buy click download earn exclusive gift guaranteed instant limited online order prize rich sale save subscribe trial unlimited vip
""".split()
VOCABULARY = dict.fromkeys(STRICT, 1.0) | dict.fromkeys(SOFT, 0.5) | dict.fromkeys(WEAK, 0.25)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(_LOWER + "0123456789")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first `://` up to `/`, `?`, `#`, A-Z in lower case; then up to `?`, `#`.

    Null, or no `://`: both are empty.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls. Rules fit their host and its subdomains, and path prefixes."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the last to be wrapped around is the longest
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


#: Terms of a vocabulary at most: it is sent to every task.
TERMS = 1 << 20
_ESCAPE = re.compile(r"%([2-7][0-9A-Fa-f])")


def read_vocabulary(terms: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, float]:
    """{term: weight} of a table of at most TERMS terms, each in lower case with its largest weight. Nulls and empty terms are left out."""
    rows = terms.where(F.col(weight).isNotNull() & (F.col(term) != "")).groupBy(F.translate(F.col(term), _UPPER, _LOWER).alias("term")).agg(F.max(F.col(weight).cast("double")).alias("weight"))
    found = {r["term"]: r["weight"] for r in rows.limit(TERMS + 1).collect()}
    if len(found) > TERMS:
        raise ValueError(f"a vocabulary has {TERMS} terms at most")
    return found


@cache
def _automaton(vocabulary: frozenset[tuple[str, float]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def plain(url: str) -> str:
    """A URL as the vocabulary sees it: escapes of printable ASCII characters decoded (once), A-Z in lower case."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url).translate(_LOWERED)


_LOWERED = str.maketrans(_UPPER, _LOWER)


def hits(text: str, vocabulary: frozenset[tuple[str, float]], limit: float = LIMIT) -> tuple[int, int, float]:
    """(strict hits, distinct soft terms, weight of those) in a text of plain(), at boundaries."""
    if not vocabulary:
        return 0, 0, 0.0
    hard, easy = 0, {}
    for end, (term, weight) in _automaton(vocabulary).iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            if weight >= limit:
                hard += 1
            else:
                easy[term] = weight
    return hard, len(easy), math.fsum(easy.values())


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, vocabulary: dict[str, float] | None = None, limit: float = LIMIT) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, strict_hits, soft_terms, soft_weight.

    A null or empty url has an empty host and path, fits no rule, has no hits and is allowed. Repeated rows are judged each;
    other columns are not read; no rows give no rows. Host, path and rules take escapes as they stand.
    """
    terms = frozenset((VOCABULARY if vocabulary is None else vocabulary).items())

    @F.pandas_udf(T.StructType([T.StructField("strict_hits", T.IntegerType()), T.StructField("soft_terms", T.IntegerType()), T.StructField("soft_weight", T.DoubleType())]))
    def counted(urls: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([hits(plain(u or ""), terms, limit) for u in urls], columns=["strict_hits", "soft_terms", "soft_weight"])
        return found.astype({"strict_hits": "int32", "soft_terms": "int32", "soft_weight": "float64"})

    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), counted(F.col(url)).alias("_hits"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("_hits.strict_hits") >= 1) | (F.col("_hits.soft_weight") >= limit), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("_hits.strict_hits").alias("strict_hits"), F.col("_hits.soft_terms").alias("soft_terms"), F.col("_hits.soft_weight").alias("soft_weight"))


def _sql() -> str:
    listed = lambda terms: ", ".join(f"'{t}'" for t in terms)
    of = lambda terms: f"len(list_distinct(list_filter(tokens, lambda t: t IN ({listed(terms)}))))"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [f"((host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.split('/', 1)[1]}'))" for _, t in ordered]
    rule = " ".join(f"WHEN {c} THEN '{t}'" for c, (_, t) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {c} THEN '{k}'" for c, (k, _) in zip(fits, ordered, strict=True))
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         array_to_string(list_transform(string_split(coalesce(url, ''), '%'), lambda x, i: CASE WHEN i = 1 THEN x
           WHEN regexp_matches(x, '^[2-7][0-9A-Fa-f]') THEN chr(('0x' || substr(x, 1, 2))::INT) || substr(x, 3) ELSE '%' || x END), '') AS decoded FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         -- terms are runs of letters and digits, so hits at boundaries are whole runs
         regexp_extract_all(translate(decoded, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS tokens FROM cut),
counted AS (
  SELECT *, len(list_filter(tokens, lambda t: t IN ({listed(STRICT)}))) AS strict_hits, {of(SOFT)} AS soft, {of(WEAK)} AS weak FROM parts)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {verdict} WHEN strict_hits >= 1 OR soft / 2 + weak / 4 >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits::INT AS strict_hits, (soft + weak)::INT AS soft_terms, soft / 2 + weak / 4 AS soft_weight
FROM counted
"""


SQL = _sql()
