"""Language identification by Bloom filters whose slots are bitmasks of languages.

Each slot of a filter holds a bit for every language, so one lookup (the AND of a few slots) returns all languages that
contain an n-gram. A document's popcounts by language, corrected for the filters' false positives, decide. The filters are
learned from counts over a bounded sample of labelled rows; documents are judged on their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows of each language that are learned from, at most.
SAMPLE = 2000
#: n-gram lengths, lookups for an n-gram, slots in the filter at least (a power of two), and characters handled at once.
LENGTHS, LOOKUPS, SLOTS, CHUNK = (2, 3, 4), 3, 1 << 20, 1 << 17
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate in any.
SHARE = 0.2
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _alphabet() -> np.ndarray:
    """By code point: its letter in lower case, or a space if it isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and low.isalpha() else i
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters with one space between runs of them and at both ends; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = _alphabet()[np.minimum(points, 0x10FFFF)]
    space = mapped == 32
    if space.all():
        return np.zeros(0, np.uint32)
    keep = ~(space & np.concatenate([[True], space[:-1]]))
    out = mapped[keep]
    return np.concatenate([[32], out, [32]] if out[-1] != 32 else [[32], out]).astype(np.uint32)


def _hashes(points: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` letters or spaces."""
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = (h ^ points[k : k + n].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """languages, slots (rows of uint64 words, a bit for a language), each language's false-positive rate, the fallback."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    fallback: str | None
    lengths: tuple[int, ...] = LENGTHS
    lookups: int = LOOKUPS

    @classmethod
    def of(cls, grams: dict[str, np.ndarray], fallback: str | None, slots: int = SLOTS, lengths: tuple[int, ...] = LENGTHS, lookups: int = LOOKUPS) -> Model:
        """From each language's n-gram hashes."""
        languages = sorted(grams)
        table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        rates = np.zeros(len(languages))
        for i, language in enumerate(languages):
            bit, used = np.uint64(1 << i % 64), np.zeros(slots, bool)
            for k in range(lookups):
                used[_slot(grams[language], k, slots)] = True
            table[used, i // 64] |= bit
            rates[i] = used.mean() ** lookups
        return cls(languages, table, rates, fallback, lengths, lookups)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram (with false positives), as rows of words."""
        out = self.slots[_slot(hashes, 0, len(self.slots))]
        for k in range(1, self.lookups):
            out = out & self.slots[_slot(hashes, k, len(self.slots))]
        return out

    def counts(self, points: np.ndarray) -> tuple[int, np.ndarray]:
        """(n-grams, of them those in each language) of letters()."""
        total, hits = 0, np.zeros(len(self.languages), np.int64)
        reach = max(self.lengths) - 1
        for at in range(0, len(points), CHUNK):
            for length in self.lengths:
                own = points[at : at + CHUNK + length - 1] if reach else points[at : at + CHUNK]
                hashes = _hashes(own, length)
                total += len(hashes)
                masks = self.masks(hashes)
                for w in range(masks.shape[1]):
                    low = masks[:, w]
                    if len(self.languages) <= 8:
                        by_mask = np.bincount(low.astype(np.uint8), minlength=256)
                        for i in range(len(self.languages)):
                            hits[i] += by_mask[(np.arange(256) >> i & 1).astype(bool)].sum()
                    else:
                        for i in range(64 * w, min(len(self.languages), 64 * w + 64)):
                            hits[i] += np.count_nonzero(low & np.uint64(1 << i % 64))
        return total, hits

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, its share of the corrected counts, the share of n-grams that it contains)."""
        points = letters(text) if text else np.zeros(0, np.uint32)
        if not len(points) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        total, hits = self.counts(points)
        real = np.clip((hits - total * self.rates) / np.maximum(1 - self.rates, 1e-9), 0, total)
        if real.sum() <= 0:
            return self.fallback or self.languages[0], 0.0, 0.0
        best = int(real.argmax())
        return self.languages[best], float(real[best] / real.sum()), float(real[best] / total)


def _slot(hashes: np.ndarray, k: int, slots: int) -> np.ndarray:
    """Double hashing from the two halves of a hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return ((low + np.uint64(k) * high) & np.uint64(slots - 1)).astype(np.int64)


def _picked(own: DataFrame, sample: int, scratch: Scratch) -> DataFrame:
    """(lang, _hash) of `sample` different texts of each language at most, those first by hash.

    own: lang, text, _hash. Only hashes under a threshold, half as many again as wanted, are told apart and ranked, so
    neither texts nor all hashes of a language come together.
    """
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_n"))
    limit = F.least(F.lit(1 << 30), F.ceil(F.lit(1.5 * sample + 64) / F.col("_n") * (1 << 30))).alias("_limit")
    limits = scratch.write(sizes.select(F.col("lang").alias("_lang"), limit), "limits")
    few = own.select("lang", "_hash").join(_small(limits), F.col("lang") == F.col("_lang")).where(F.shiftrightunsigned("_hash", 34) < F.col("_limit"))
    unsigned = F.shiftrightunsigned("_hash", 1)  # the order in which the threshold takes them
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(unsigned, "_hash"))
    return scratch.write(few.select("lang", "_hash").distinct().withColumn("_turn", turn).where(F.col("_turn") <= sample).select("lang", "_hash"), "picked")


#: Rows up to which a table is sent to all tasks.
SMALL = 1 << 20


def _small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it has SMALL rows or fewer; a row here has tens of bytes."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def train(rows: DataFrame, sample: int = SAMPLE, grams: int | None = None, share: float = SHARE, text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows, those without a lang or text left out.

    Of each language `sample` different texts are used at most, those first by a hash, each once however often it is
    repeated, so rows and partitions may be in any order. All their n-grams count, unless `grams` names a number of the most
    frequent ones; the filter has 16 slots for each of the largest language's. No rows give a model without languages.
    """
    scratch = Scratch(rows.sparkSession, "langid")
    own = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).withColumn("_hash", F.xxhash64("text"))
    picked = _picked(own, sample, scratch).select(F.col("lang").alias("_l"), F.col("_hash").alias("_h"))
    chosen = own.join(_small(picked), (F.col("lang") == F.col("_l")) & (F.col("_hash") == F.col("_h")), "left_semi").dropDuplicates(["lang", "_hash"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, docs in batch.groupby("lang"):
                seen: list[np.ndarray] = [np.zeros(0, np.uint64)]
                for body in docs["text"]:
                    points = letters(body)
                    seen += [_hashes(points, n) for n in LENGTHS]
                values, times = np.unique(np.concatenate(seen), return_counts=True)
                yield pd.DataFrame({"lang": language, "gram": values.view(np.int64), "n": times.astype(np.int64)})

    kind = rows.schema[lang].dataType.simpleString()
    counted = chosen.select("lang", "text").mapInPandas(count, f"lang {kind}, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = scratch.write(counted, "counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rated = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
    kept = rated.where(F.col("rate") >= share * F.col("top"))
    if grams is not None:
        kept = kept.withColumn("_turn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_turn") <= grams)
    by: dict[str, list[int]] = {}
    for r in kept.select("lang", "gram").collect():
        by.setdefault(r["lang"], []).append(r["gram"])
    first = totals.orderBy(F.desc("total"), "lang").first()
    slots = max(SLOTS, 1 << (16 * max(map(len, by.values()), default=1) - 1).bit_length())
    return Model.of({k: np.array(v, np.int64).view(np.uint64) for k, v in by.items()}, first and first["lang"], slots)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves remainder 1 when divided by 3; a null id's text is empty."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """A row for each of docs: _row (its columns) and _lang (lang_pred, score, known: the share of n-grams that the language contains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "known"])

    return docs.select(F.struct("*").alias("_row"), predict(F.col(text)).alias("_lang"))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Rows that aren't held out and have a lang teach; lang, source and ids are no inputs of a prediction. lang_pred is `und`
    with score 0 if the text is null or has no letter, or nothing could be learned; a text of which no n-gram is known gets
    the language with most n-grams, with score 0. Repeated rows are judged alike; no rows give no rows.
    """
    model = train(docs.where(~held_out(F.col(doc_id))), text=text, lang=lang, **options)
    rows = judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), F.col("_lang.lang_pred").alias("lang_pred"), F.col("_lang.score").alias("score"))


def accepted(docs: DataFrame, least_known: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of docs, in its columns, whose text is in a language: not `und`, and its n-grams known to that language.

    So null texts, texts without a letter and, if nothing could be learned, all texts go. Repeated rows share their fate.
    """
    model = train(docs.where(~held_out(F.col(doc_id))), text=text, lang=lang, **options)
    return judged(docs, model, text).where((F.col("_lang.lang_pred") != UNKNOWN) & (F.col("_lang.known") >= least_known)).select("_row.*")
