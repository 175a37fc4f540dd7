"""SimHash near-dedup by one-wildcard segment signatures.

A fingerprint of 64 bits is cut into two segments of 32. Fingerprints that differ in at most 3 bits differ in at most
one bit in one of the two, so they agree in one of that segment's 32 variants that leave out one bit. An equality join on
(segment, bit left out, other 31 bits) finds every pair; the pair is verified on all 64 bits within the join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components

DISTANCE, WORDS, SEED = 3, 3, 42

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int16)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included. Null or wordless: 0.

    Lower-cases A-Z only and splits at ASCII white space; with fewer words than a shingle has, the whole sequence is the
    one shingle. A bit is 1 if it is set in over half the XXH64 values.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = (ends[: len(found) - words + 1] - np.fromiter(map(len, found[: len(found) - words + 1]), np.int64) - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8) + _LANES
        ones += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return text.map(fingerprint, na_action=None).astype("int64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and a column _fp. Batches of long texts stay small, as Arrow batches are bounded by the session's settings."""
    return docs.withColumn("_fp", _fingerprints(F.col(text)))


def signatures(prints: DataFrame) -> DataFrame:
    """(_fp, _key): 64 rows of two longs for each distinct fingerprint, so copies are not expanded."""
    # the rows grow 64-fold, so as many tasks as a shuffle has share them, however small the fingerprints are together; dealt
    # by the fingerprint itself they would stay in the exchange of distinct(), whose small partitions are put together
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = prints.select("_fp").distinct().repartition(tasks, F.xxhash64("_fp")).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    half = "(shiftrightunsigned(_fp, if(_bit >= 32, 32, 0)) & 4294967295L)"
    return signed.select("_fp", F.expr(f"({half} & ~shiftleft(1L, _bit % 32)) | shiftleft(cast(_bit as bigint), 32)").alias("_key"))


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a < b) of distinct values of prints._fp that differ in 1 to 3 bits, each once."""
    signed = signatures(prints)
    x, y = signed.alias("x"), signed.alias("y")
    same = "(shiftrightunsigned(x._fp ^ y._fp, if(shiftright(x._key, 32) >= 32, 32, 0)) & 4294967295L) = 0"
    met = x.join(
        y,
        F.expr(
            "x._key = y._key and x._fp < y._fp and bit_count(x._fp ^ y._fp) <= 3"
            # equal segments share all 32 variants: the first counts; the upper segment counts if the lower one hasn't
            f" and (not {same} or shiftright(x._key, 32) % 32 = 0)"
            " and (shiftright(x._key, 32) < 32 or bit_count((x._fp ^ y._fp) & 4294967295L) > 1)"
        ),
    )
    return met.select(F.col("x._fp").alias("a"), F.col("y._fp").alias("b"))


def joining(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Some of links(), which connect all that links() connects.

    A group of m near copies has m^2 links, so first each print is held against the least of those that share a signature;
    then, of signatures whose prints are not yet in one component, each two prints of different components.
    """
    signed = signatures(prints)
    # least and greatest are taken before the shuffle too, so a key of many prints is no task's whole work
    ends = signed.groupBy("_key").agg(F.min("_fp").alias("_low"), F.max("_fp").alias("_high")).where("_low < _high").select("_key", "_low")
    shared = scratch.write(signed.join(scratch.write(ends, "ends"), "_key"), "shared")
    close = f"bit_count({{}} ^ {{}}) <= {DISTANCE}"
    stars = scratch.write(shared.where("_fp <> _low and " + close.format("_fp", "_low")).select(F.col("_low").alias("a"), F.col("_fp").alias("b")).distinct(), "stars")
    named = shared.drop("_low").join(components(stars, scratch).select(F.col("id").alias("_fp"), "component"), "_fp", "left")
    named = scratch.write(named.withColumn("_of", F.coalesce("component", "_fp")).drop("component"), "named")
    mixed = named.groupBy("_key").agg(F.min("_of").alias("_low"), F.max("_of").alias("_high")).where("_low <> _high").select("_key")
    left = scratch.write(named.join(mixed, "_key"), "mixed")
    x, y = left.alias("x"), left.alias("y")
    met = x.join(y, F.expr("x._key = y._key and x._fp < y._fp and x._of <> y._of and " + close.format("x._fp", "y._fp")))
    return stars.unionByName(met.select(F.col("x._fp").alias("a"), F.col("y._fp").alias("b")).distinct())


def classes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(_fp, _group) for every fingerprint linked with another; _group is one fingerprint of the component."""
    found = components(joining(prints, scratch), scratch)
    return found.select(F.col("id").alias("_fp"), F.col("component").alias("_group"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable by links between fingerprints at 3 or fewer differing bits. Null and
    wordless texts have fingerprint 0 and link like others. Null ids take part, but name a component only if it has no
    other id; repeated rows are repeated in the result; other columns are not read; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "_fp"), "prints")
    grouped = scratch.write(_named(prints, scratch, lambda least: classes(least, scratch)), "groups")
    return prints.join(grouped, "_fp").select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(prints: DataFrame, scratch: Scratch, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_fp, _group, component_id) for every fingerprint; linked gives classes() of the fingerprints."""
    least = scratch.write(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "least")
    groups = scratch.write(least.join(linked(least), "_fp", "left").withColumn("_group", F.coalesce("_group", "_fp")), "classes")
    return groups.select("_fp", "_group").join(groups.groupBy("_group").agg(F.min("_least").alias("component_id")), "_group")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one for each group of near duplicates: that with the smallest doc_id (nulls last).

    Of rows that share the kept doc_id within a group one stays. Columns are those of docs, in its order.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).withColumn("_text", F.xxhash64("text"))
    prints = scratch.write(prints.select("doc_id", "_fp", "_text"), "prints")
    return first_of_each(docs, prints, lambda least: classes(least, scratch), scratch, doc_id, text)


def first_of_each(docs: DataFrame, prints: DataFrame, linked: Callable[[DataFrame], DataFrame], scratch: Scratch, doc_id: str, text: str) -> DataFrame:
    """one_of_each() by given prints: doc_id, _fp and _text, the hash of the text, of every row of docs."""
    rows = prints.select("doc_id", "_fp", "_text").join(_named(prints, scratch, linked), "_fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # of the rows with the group's least id, those with the least text hash; _n tells whether that is one row
    best = rows.groupBy("_group", "doc_id", "_text").agg(F.count("*").alias("_n")).groupBy("_group", "doc_id").agg(F.min(F.struct("_text", "_n")).alias("_best"))
    best = scratch.write(best.select(F.col("doc_id").alias("_id"), F.col("_best._text").alias("_text"), F.col("_best._n").alias("_n")), "best")
    # the columns of docs go along as one, so that no name of theirs meets one of these
    tagged = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_doc"), F.xxhash64(F.col(text)).alias("_hash"))
    kept = tagged.join(best, tagged["_doc"].eqNullSafe(best["_id"]) & (tagged["_hash"] == best["_text"]))
    return kept.where("_n = 1").select("_row.*").unionByName(kept.where("_n > 1").dropDuplicates(["_doc", "_hash"]).select("_row.*"))
