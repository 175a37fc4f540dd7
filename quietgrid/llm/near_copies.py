"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and all that they link.

Links of SimHash at 3 words and 3 bits count besides. SimHash alone can't give these pairs: at 0.8 about 10 of 64 bits differ,
and a fingerprint of any length differs in that share of its bits, far more than segments with one wildcard find. So further
candidates are those that agree in one of 24 bands of 4 minimum hashes, which a pair at 0.8 misses three times in a million
and a closer pair less often. Every candidate is verified on the whole sets. Texts of equal sets are one row, so copies are
not expanded. Of a band's bucket first a few leaders are held against all others, which links a large group in a linear
number of pairs; the first leader is the set with most company in its buckets, such as the text that others are edits of.
What is left in buckets of several components goes through an exact join: two sets of that similarity share one of the
rarest fifth of their shingles, at places that leave room for the overlap they need. So no link is left out, and a text whose
edits nobody else has meets nobody.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, joined
from .simhash import fingerprint, first_of_each
from .simhash import joining as close_prints

#: Words of a shingle; similarity of near copies, as a fraction; bands, hashes in a band, leaders of a bucket.
WORDS, SIMILAR, BANDS, ROWS, LEADERS, SEED = 5, (4, 5), 24, 4, 3, 42

#: A shingle's rows are dealt to several tasks if they are more than DEAL and more than one in COMMON of all rows.
DEAL, COMMON = 500, 10_000

_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
_ODD, _FLIP, _PLACE = _RANDOM[0] | np.uint64(1), _RANDOM[1], (_RANDOM[2] | np.uint64(1)).reshape(BANDS, ROWS)
_TURN = np.random.default_rng(SEED + 1).integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; words as in fingerprint(). Null or wordless: none.

    With fewer words than a shingle has, the whole sequence is the one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    words, n = np.array([digest(w) for w in found], np.uint64), len(found) - WORDS + 1
    mixed = sum(words[k : k + n] * _TURN[k] for k in range(WORDS))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band; texts with no words have none."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 10):
        least = np.minimum(least, ((found[at : at + (1 << 10)] ^ _FLIP[:, None]) * _ODD[:, None]).min(1))
    keys = (least.reshape(BANDS, ROWS) * _PLACE).sum(1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


@F.pandas_udf(T.StructType([T.StructField("_fp", T.LongType()), T.StructField("_sim", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("_bands", T.ArrayType(T.LongType()))]))
def _prints(text: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in text]
    prints = [int(np.array(xxhash.xxh64_intdigest(s.tobytes(), SEED), np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
    return pd.DataFrame({"_fp": np.array(prints, np.int64), "_sim": np.array([fingerprint(t) for t in text], np.int64), "_n": np.array([len(s) for s in sets], np.int32), "_bands": [bands(s) for s in sets]})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(text: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in text], dtype=object)


def similar(a: str, b: str) -> Column:
    """Whether two sets, columns of distinct shingles, are near copies."""
    both = F.size(F.array_intersect(a, b))
    return both * SIMILAR[1] >= (F.size(a) + F.size(b) - both) * SIMILAR[0]


def _buckets(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """_band, _key, _fp, _n, _size for buckets of two and more (_size) distinct sets."""
    one = prints.groupBy("_fp").agg(F.first("_n").alias("_n"), F.first("_bands").alias("_bands"))
    rows = scratch.write(one.select("_fp", "_n", F.posexplode("_bands").alias("_band", "_key")), "bands")
    shared = rows.groupBy("_band", "_key").agg(F.count("*").alias("_size")).where("_size > 1")
    return scratch.write(rows.join(shared, ["_band", "_key"]), "buckets")


def _leading(buckets: DataFrame) -> DataFrame:
    """Pairs a < b of each bucket's leaders (that with most company in all its buckets, others by hash) with its other sets."""
    own = F.struct("_fp", "_n")
    company = buckets.groupBy("_fp").agg(F.sum("_size").alias("_company"))
    first = F.max_by(own, F.struct("_company", "_fp"))
    lead = buckets.join(company, "_fp").groupBy("_band", "_key").agg(F.array_distinct(F.array(first, *(F.min_by(own, F.struct(F.xxhash64("_fp", F.lit(k)), "_fp")) for k in range(1, LEADERS)))).alias("_lead"))
    met = buckets.join(lead.select("_band", "_key", F.explode("_lead").alias("_lead")), ["_band", "_key"]).where("_fp <> _lead._fp")
    return met.where(_near_sizes("_n", "_lead._n")).select(F.least("_fp", "_lead._fp").alias("a"), F.greatest("_fp", "_lead._fp").alias("b")).distinct()


def _near_sizes(m: str, n: str) -> str:
    return f"least({m}, {n}) * {SIMILAR[1]} >= greatest({m}, {n}) * {SIMILAR[0]}"


def _heavy(counts: DataFrame, count: str, rows: int) -> DataFrame:
    """(_shingle, _times) for shingles with more than DEAL rows and more than one in COMMON of all: at most COMMON of them.

    A table of _times * _times tasks has about that many rows of the shingle in each when it is dealt once.
    """
    most = max(DEAL, -(-rows // COMMON))
    return counts.where(F.col(count) > most).select("_shingle", F.ceil(F.sqrt(F.col(count) / most)).cast("int").alias("_times"))


def _with_times(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(heavy), "_shingle", "left").withColumn("_times", F.coalesce("_times", F.lit(1)))


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col("_times")).cast("int")


def _parts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("_times") - 1))


def _apart(buckets: DataFrame, found: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a < b of different components that may be near copies, among the sets in buckets of several components.

    Shingles are ordered by how many of those sets have them. If the first that two sets share stands at places p and q, they
    share n - p and m - q at most, and near copies share 4/9 of n + m at least. Pairs of different components have one that
    isn't of the shingle's main component, so a large component isn't held against itself. The rows of a shingle that very many
    sets have are dealt to several tasks, in every join.
    """
    named = buckets.join(found.select(F.col("id").alias("_fp"), "component"), "_fp", "left").withColumn("_of", F.coalesce("component", "_fp"))
    named = scratch.write(named.select("_band", "_key", "_fp", "_n", "_of"), "named")
    mixed = named.groupBy("_band", "_key").agg(F.min("_of").alias("_low"), F.max("_of").alias("_high")).where("_low <> _high").select("_band", "_key")
    left = named.join(mixed, ["_band", "_key"]).select("_fp", "_n", "_of").distinct()
    rows = left.join(sets.select("_fp", "_set"), "_fp").select("_fp", "_n", "_of", F.explode("_set").alias("_shingle"))
    rows = scratch.write(rows, "elements")
    counts = scratch.write(rows.groupBy("_shingle").agg(F.count("*").alias("_common")).where("_common > 1"), "counts")
    heavy = scratch.write(_heavy(counts, "_common", rows.count()), "heavy")
    spread = _with_times(rows, heavy).withColumn("_x", _part("_fp")).drop("_times")
    named_counts = _with_times(counts, heavy).withColumn("_x", _parts()).drop("_times")
    rows = spread.join(named_counts, ["_shingle", "_x"], "left").withColumn("_common", F.coalesce("_common", F.lit(1)))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_fp").orderBy("_common", "_shingle")) - 1)
    short = f"_common > 1 and _at * {SIMILAR[1]} <= _n * {SIMILAR[1] - SIMILAR[0]}"
    rare = scratch.write(rows.where(short).select("_fp", "_n", "_of", "_shingle", "_at"), "rare")
    kinds = rare.groupBy("_shingle", "_of").count().groupBy("_shingle")
    main = kinds.agg(F.max_by("_of", F.struct("count", "_of")).alias("_main"), F.count("*").alias("_kinds"), F.sum("count").alias("_rows")).where("_kinds > 1")
    main = scratch.write(main.select("_shingle", "_main", "_rows"), "main")
    heavy = scratch.write(_heavy(main, "_rows", rare.count()), "heavy")
    rare = _with_times(rare, heavy).withColumn("_x", _part("_fp")).join(_with_times(main, heavy).withColumn("_x", _parts()).drop("_times", "_rows"), ["_shingle", "_x"])
    rare = scratch.write(rare, "rare")
    # a heavy shingle's rows meet in a square of tasks: one side is dealt by row and the other by column
    x = rare.where("_of <> _main").withColumn("_y", _parts()).alias("x")
    y = rare.withColumn("_y", F.col("_x")).withColumn("_x", _parts()).alias("y")
    need = f"{SIMILAR[0]} * (x._n + y._n)"
    room = " and ".join(f"{sum(SIMILAR)} * ({t}._n - {t}._at) >= {need}" for t in "xy")
    met = x.join(y, F.expr(f"x._shingle = y._shingle and x._x = y._x and x._y = y._y and x._of <> y._of and (y._of = y._main or x._fp < y._fp) and {room}"))
    return met.select(F.least("x._fp", "y._fp").alias("a"), F.greatest("x._fp", "y._fp").alias("b")).distinct()


def _simhash_links(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of sets that the links of SimHash and equal fingerprints connect; one set stands for each fingerprint."""
    stands = scratch.write(prints.groupBy("_sim").agg(F.min("_fp").alias("_for")), "stands")
    same = prints.select("_sim", "_fp").distinct().join(stands, "_sim").where("_fp <> _for").select(F.col("_for").alias("a"), F.col("_fp").alias("b"))
    close = close_prints(stands.select(F.col("_sim").alias("_fp")), scratch)
    a, b = (stands.select(F.col("_sim").alias(k), F.col("_for").alias(f"_{k}")) for k in "ab")
    return scratch.write(same.unionByName(close.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "close")


def classes(prints: DataFrame, docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(_fp, _group) for every set linked with another. prints: doc_id, _fp, _sim, _text (hash of the text), _n, _bands of docs."""
    buckets = _buckets(prints, scratch)
    # one text of each set that is in a bucket
    places = prints.groupBy("_fp").agg(F.min(F.struct("doc_id", "_text")).alias("_at")).join(buckets.select("_fp").distinct(), "_fp", "left_semi")
    places = places.select("_fp", F.col("_at.doc_id").alias("_id"), F.col("_at._text").alias("_text"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_hash", F.xxhash64("text"))
    met = own.join(places, own["doc_id"].eqNullSafe(places["_id"]) & (own["_hash"] == places["_text"])).groupBy("_fp").agg(F.first("text").alias("text"))
    sets = scratch.write(met.select("_fp", _sets("text").alias("_set")), "sets")
    left, right = (sets.select(F.col("_fp").alias(k), F.col("_set").alias(f"_{k}")) for k in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        return scratch.write(pairs.join(left, "a").join(right, "b").where(similar("_a", "_b")).select("a", "b"), "links")

    tried = scratch.write(_leading(buckets), "tried")
    links = verified(tried).unionByName(_simhash_links(prints, scratch))
    found = scratch.write(components(links, scratch), "found")
    rest = _apart(buckets, found, sets, scratch).join(tried, ["a", "b"], "left_anti")
    found = joined(found, verified(rest), scratch)
    return found.select(F.col("id").alias("_fp"), F.col("component").alias("_group"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one for each component of near copies, chosen as in simhash.one_of_each(). Wordless texts are copies of each other."""
    scratch = Scratch(docs.sparkSession, "near_copies")
    prints = docs.select(F.col(doc_id).alias("doc_id"), _prints(F.col(text)).alias("_p"), F.xxhash64(text).alias("_text"))
    prints = scratch.write(prints.select("doc_id", "_text", "_p.*"), "prints")
    return first_of_each(docs, prints, lambda least: classes(prints, docs, doc_id, text, scratch), scratch, doc_id, text)
