"""Removal of lines that spread over many sites, in DataFrame functions alone.

HyperLogLog sketches of the sites, one per line hash, merge by aggregation. Lines whose estimate is near the threshold get
an exact distinct count, so an estimate alone decides only where it is far off. A line that spreads stays once, in the
document with the smallest id that has it, so no text goes from the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_SITES = 8
#: log2 of the sketch's buckets, for a relative standard error of 1.6 %; estimates within BAND of the threshold (and one more) are counted exactly.
LOG_BUCKETS, BAND = 12, 0.15


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" ")))


def _filled(text: Column) -> Column:
    return F.filter(_lines(text), lambda x: F.btrim(x, F.lit(" ")) != "")


def spread_lines(docs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(occurrences (_id, _hash, _key, _at, _site) of lines that may spread, lines (_key, _owner) that do).

    docs: _id, _hash (of the text), _site, _text. A line on min_sites sites has that many occurrences and two different
    sites at least, which is counted first, with map-side combine, so that sketches are made for few lines.
    """
    found = docs.select("_id", "_hash", F.xxhash64("_site").alias("_site"), F.posexplode(_lines(F.col("_text"))).alias("_at", "_line")).where(F.btrim("_line", F.lit(" ")) != "")
    found = found.select("_id", "_hash", "_site", "_at", _key(F.col("_line")).alias("_key"))
    maybe = found.groupBy("_key").agg(F.count("*").alias("n"), F.min("_site").alias("a"), F.max("_site").alias("b")).where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | (F.lit(min_sites) < 2)))
    maybe = scratch.write(maybe.select("_key"), "candidates")
    occurrences = scratch.write(found.join(maybe, "_key", "left_semi"), "occurrences")
    sketched = occurrences.groupBy("_key").agg(F.hll_sketch_agg("_site", F.lit(LOG_BUCKETS)).alias("sketch"), F.min("_id").alias("_owner"))
    sketched = scratch.write(sketched.select("_key", "_owner", F.hll_sketch_estimate("sketch").alias("sites")), "sketches")
    near = F.abs(F.col("sites") - min_sites) <= F.lit(BAND * min_sites + 1)
    exact = occurrences.join(sketched.where(near).select("_key"), "_key", "left_semi").groupBy("_key").agg(F.count_distinct("_site").alias("exact"))
    spread = sketched.where(~near & (F.col("sites") > min_sites)).select("_key", "_owner")
    spread = spread.union(sketched.where(near).join(exact.where(F.col("exact") >= min_sites), "_key", "left_semi").select("_key", "_owner"))
    return occurrences, scratch.write(spread, "spread")


def _without(text: Column, gone: Column) -> Column:
    """text without the lines at the positions in `gone`. Both arrays are bound once, so time is in proportion to the lines."""
    bound = F.array(F.struct(_lines(text).alias("lines"), gone.alias("gone")))
    kept = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"])
    return F.transform(bound, lambda s: F.array_join(F.transform(kept(s), lambda i: s["lines"][i]), "\n"))[0]


def clean(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """A row for each of docs: _row (its columns), _lines (those that aren't blank), _removed (lines taken out of it) and _clean (the text that is left).

    A line is compared without its outer spaces. Blank lines and everything but removed lines stay as they are. A null site
    is a site; null text stays null with 0 lines; empty tables stay empty. Of rows that share an id each is cleaned alike;
    a null id owns a line only if no row with an id has it. docs may have columns of any names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    held = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.col(site).alias("_site"), F.col(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    occurrences, spread = spread_lines(held.drop("_row"), scratch, min_sites)
    own = F.col("_id").eqNullSafe(F.col("_owner"))
    # positions are those of a text, so rows that repeat both id and text share one list, and null ids don't share any other
    again = F.row_number().over(Window.partitionBy("_id", "_hash", "_key").orderBy("_at")) > 1
    gone = occurrences.join(spread, "_key").select("_id", "_hash", "_key", "_at", own.alias("_own")).distinct().withColumn("_gone", ~F.col("_own") | again)
    lists = scratch.write(gone.where("_gone").groupBy(F.col("_id").alias("_list_id"), F.col("_hash").alias("_list_hash")).agg(F.collect_list("_at").alias("_at")), "lists")
    # the lists grow with the corpus, so the join is by shuffle at every size
    joined = held.join(lists.hint("merge"), held["_id"].eqNullSafe(lists["_list_id"]) & (held["_hash"] == lists["_list_hash"]), "left")
    lines = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size(_filled(F.col("_text")))).cast("long")
    cleaned = F.when(F.col("_at").isNotNull(), _without(F.col("_text"), F.col("_at"))).otherwise(F.col("_text"))
    return joined.select("_row", F.col("_id"), lines.alias("_lines"), F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size("_at")).cast("long").alias("_removed"), cleaned.alias("_clean"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, lines, removed, text (what is left of it). See clean()."""
    return clean(docs, **options).select(F.col("_id").alias("doc_id"), F.col("_lines").alias("lines"), F.col("_removed").alias("removed"), F.col("_clean").alias("text"))


def strip(docs: DataFrame, **options) -> DataFrame:
    """docs in its own columns, with cleaned texts; documents of which removal leaves no line go. Awkward rows are as in clean()."""
    text = options.get("text", "text")
    rows = clean(docs, **options).where((F.col("_removed") == 0) | (F.col("_removed") < F.col("_lines")))
    out = {n: F.col("_row")[n] for n in docs.columns} | {text: F.col("_clean")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_removed") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row")["n_chars"])
    return rows.select(*(c.alias(n) for n, c in out.items()))


SQL = r"""
WITH l AS (
  SELECT doc_id, source, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rid FROM documents) WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ') AS key FROM l),
spread AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT coalesce(source, chr(0))) >= 8),
m AS (
  SELECT k.*, s.key IS NOT NULL AND (k.doc_id IS DISTINCT FROM s.owner OR row_number() OVER (PARTITION BY rid, k.key ORDER BY pos) > 1) AS gone
  FROM k LEFT JOIN spread s ON k.key = s.key)
SELECT d.doc_id, coalesce(x.lines, 0)::BIGINT AS lines, coalesce(x.removed, 0)::BIGINT AS removed,
       CASE WHEN d.text IS NULL THEN NULL WHEN x.removed > 0 THEN coalesce(x.kept, '') ELSE d.text END AS text
FROM (SELECT *, row_number() OVER () AS rid FROM documents) d LEFT JOIN (
  SELECT rid, count(*) FILTER (key <> '') AS lines, count(*) FILTER (gone) AS removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM m GROUP BY rid) x ON d.rid = x.rid
"""
