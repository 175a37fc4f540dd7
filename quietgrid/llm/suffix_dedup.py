"""Repeated passages by sparse suffix arrays.

Suffixes (of words) are kept only where content selects them: a position whose 20-word hash is the least of a window of 31.
Documents that share a run of 50 words share such a position in it. Suffixes are sorted; neighbours that share those 20
words are compared and extended left and right. A run reaches no further than 30 words beyond its outermost kept positions,
so 30 words on either side of each tell its whole extent. A suffix's longest match need not stand beside it if it is long on
the left; an exact check follows, which looks up each window of 50 words around a kept position that no neighbour had.

Suffixes of the same 20 words meet in one task, which sorts its suffixes and takes them as a stream. Those of 20 words that
very many suffixes begin with are dealt to several tasks, and a join of windows finds what those have in common. Words are
compared by their hashes: 31 bits for each of 30 words and 64 bits for the 20 together.

Two passes read the texts. The first counts the 20-word hashes; those that occur once can't repeat. The second keeps the
words around the others. Between them goes a Bloom filter, sized by the count of those others up to 64 MiB; beyond, more
suffixes pass that have no partner, which costs time but changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_WORDS, SEED_WORDS = 50, 20
#: log2 of the Bloom filter's 64-bit words at most (64 MiB), and its bits for each seed; log2 of the slots for common seeds.
FILTER_LOG, FILTER_BITS, SLOT_LOG = 23, 8, 20
#: Suffixes of a seed (about) that are compared in one task, as are at least so many at once.
BLOCK = 4096

#: Stands for a null id inside, so that batches with nulls don't turn ids into floating-point numbers.
_NO_ID = -(1 << 63)

_R, _B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CONTEXT = "seed long, part int, key long, doc_id long, at int, before binary, after binary"
_SPAN = "key long, doc_id long, start int, stop int, partner long, window long, kind int"
#: Kinds of rows: a span; a window of a common seed that another document of the task's part has; one that none there has.
_FOUND, _OFFERED, _WANTED = 0, 1, 2


@cache
def _powers(base: int, log: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse, for k below 2 ** log, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.ones(1, np.uint64)
        while len(row) < 1 << log:
            row = np.concatenate([row, row * np.uint64(pow(b, len(row), 1 << 64))])
        out.append(row)
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_R)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_B)
    return h ^ (h >> np.uint64(32))


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[a:b], the same wherever the values stand."""
    log = max(16, int(len(values)).bit_length())
    up, down = _powers(base, log)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * down[: len(values)], dtype=np.uint64)])
    return _mixed((sums[stops] - sums[starts]) * up[starts])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: runs of other bytes than ASCII white space, A-Z in lower case."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    return _ranges(raw.astype(np.uint64) + np.uint64(1), starts, stops, _R) ^ (stops - starts).astype(np.uint64)


def positions(words: np.ndarray, seed: int = SEED_WORDS, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of the seed words there): the least hash of each window of least - seed + 1, the first of equals."""
    n, window = len(words), least - seed + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - seed + 1)
    grams = _ranges(words, at, at + seed, _B)
    found = []
    for i in range(0, n - least + 1, 1 << 16):
        offsets = np.lib.stride_tricks.sliding_window_view(grams[i : i + (1 << 16) + window - 1], window).argmin(1)
        found.append(np.unique(i + np.arange(len(offsets)) + offsets))
    picked = np.unique(np.concatenate(found))
    return picked, grams[picked]


def _filtered(seeds: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.ones(len(seeds), bool)
    spot = seeds & np.uint64((len(bits) << 6) - 1)
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _around(words: np.ndarray, at: np.ndarray, seed: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before each position, nearest first, and those after its seed, as 32-bit hashes; 0 beyond the text's ends."""
    short = np.concatenate([np.zeros(reach, np.uint32), (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(reach, np.uint32)])
    steps = np.arange(reach)
    return short[at[:, None] + reach - 1 - steps], short[at[:, None] + reach + seed + steps]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows; 0 stands for no word and is common with nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def _pairs(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: each row's nearest neighbours of another document on either side, if they are of its group."""
    n = len(keys)
    edge = np.flatnonzero(keys[1:] != keys[:-1])  # the last row before another key begins
    rows = np.arange(n)
    before = np.searchsorted(edge, rows, "left") - 1
    after = np.searchsorted(edge, rows, "left")
    a = [rows[before >= 0], rows[after < len(edge)]]
    b = [edge[before[before >= 0]], edge[after[after < len(edge)]] + 1]
    i, j = np.concatenate(a), np.concatenate(b)
    same = group[i] == group[j]
    return i[same], j[same]


def _windows(seeds: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether all words are there) of the windows around each row that have 0, 1, ... reach words before its seed."""
    reach = before.shape[1]
    sums = []
    for side, base in ((before, _R), (after, _B)):
        h = np.zeros((len(side), reach + 1), np.uint64)
        for k in range(reach):
            h[:, k + 1] = _mixed(h[:, k] * np.uint64(base) + side[:, k].astype(np.uint64))
        sums.append(h)
    there = [np.concatenate([np.ones((len(x), 1), bool), x != 0], 1) for x in (before, after)]
    return _mixed(seeds.view(np.uint64)[:, None] + sums[0] * np.uint64(_B) + sums[1][:, ::-1] * np.uint64(_R)), there[0] & there[1][:, ::-1]


def _looked_up(keys, seeds, at, docs, before, after, shown, split, least) -> list[pd.DataFrame]:
    """Windows of whole groups' rows that other documents have, but those shown; and what split seeds offer and want."""
    hashes, there = _windows(seeds, before, after)
    row, ahead = np.nonzero(there)
    if not len(row):
        return []
    order = np.argsort(hashes[row, ahead], kind="stable")
    row, ahead = row[order], ahead[order]
    window = hashes[row, ahead]
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(window))))
    by_key = np.lexsort((keys[row], group))
    low, high = by_key[first], by_key[np.append(first[1:], len(window)) - 1]
    shared = keys[row[low]] != keys[row[high]]

    def rows_of(x: np.ndarray, partner: np.ndarray | int, number: np.ndarray | int, kind: int) -> pd.DataFrame:
        begin = at[row[x]] - ahead[x]
        return pd.DataFrame({"key": keys[row[x]], "doc_id": docs[row[x]], "start": begin, "stop": begin + least, "partner": partner, "window": number, "kind": kind})

    new = np.flatnonzero(shared[group] & ~shown[row, ahead])
    lowest, highest = row[low[group[new]]], row[high[group[new]]]
    out = [rows_of(new, np.where(keys[lowest] == keys[row[new]], docs[highest], docs[lowest]), 0, _FOUND)]
    # of what is shared here two documents' rows are offered, so that any document elsewhere meets another one
    offers = split[row[first]] & shared
    for kind, x in ((_OFFERED, low[offers]), (_OFFERED, high[offers]), (_WANTED, np.flatnonzero(split[row] & ~shared[group]))):
        out.append(rows_of(x, _NO_ID, window[x].view(np.int64), kind))
    return [o for o in out if len(o)]


def _compared(rows: pd.DataFrame, seed: int, least: int) -> pd.DataFrame:
    """Of sorted rows of whole groups (a seed, or a part of one): spans of `least` words and more that other documents have, as _SPAN."""
    reach, n = least - seed, len(rows)
    keys, seeds, parts, at, docs = (rows[c].to_numpy() for c in ("key", "seed", "part", "at", "doc_id"))
    before, after = (np.frombuffer(b"".join(rows[c]), np.uint32).reshape(n, reach) for c in ("before", "after"))
    group = np.cumsum(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (parts[1:] != parts[:-1])]))
    i, j = _pairs(keys, group)
    left, right = _common(before[i], before[j]), _common(after[i], after[j])
    long = left + right >= reach
    i, j, left, right = i[long], j[long], left[long], right[long]
    # windows with 0 to reach words before the seed: which of them a neighbour has shown
    shown = np.zeros((n, reach + 2), np.int16)
    np.add.at(shown, (i, reach - right), 1)
    np.add.at(shown, (i, left + 1), -1)
    found = pd.DataFrame({"key": keys[i], "doc_id": docs[i], "start": at[i] - left, "stop": at[i] + seed + right, "partner": docs[j], "window": 0, "kind": _FOUND})
    return pd.concat([found, *_looked_up(keys, seeds, at, docs, before, after, shown.cumsum(1) > 0, parts >= 0, least)], ignore_index=True)


def _whole_groups(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Sorted batches, put together to `block` rows or more that end where a group ends."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) < block:
            continue
        last = batch.iloc[-1]
        if held[0]["seed"].iloc[0] == last["seed"] and held[0]["part"].iloc[0] == last["part"]:
            continue
        rows = pd.concat(held, ignore_index=True)
        open_ = int(((rows["seed"] == last["seed"]) & (rows["part"] == last["part"])).to_numpy().argmax())
        yield rows.iloc[:open_].reset_index(drop=True)
        held = [rows.iloc[open_:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _filter(seeds: DataFrame, log: int) -> np.ndarray:
    """2 ** log 64-bit words in which a bit is set for each seed."""
    spot = F.col("seed").bitwiseAND(F.lit((1 << log + 6) - 1))
    words = seeds.groupBy(F.shiftrightunsigned(spot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << log, np.int64)  # as many rows at most
    bits[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return bits.view(np.uint64)


def _levels(counted: DataFrame, block: int, log: int) -> np.ndarray:
    """By slot of a seed (its upper bits): log16 of the parts that its suffixes are dealt to, so that a part has `block` or fewer.

    Seeds that share a slot with a more common one are split for nothing, which changes no result.
    """
    level = F.ceil(F.log(16.0, F.col("count") / block)).cast("int")
    slots = counted.where(F.col("count") > block).groupBy(F.shiftrightunsigned("seed", 64 - log).alias("slot")).agg(F.max(level).alias("level")).toArrow()
    out = np.zeros(1 << log, np.int8)  # as many rows at most
    out[np.asarray(slots.column("slot"))] = np.asarray(slots.column("level"))
    return out


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, seed: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, filter_log: int = FILTER_LOG, slot_log: int = SLOT_LOG) -> DataFrame:
    """A row per repeated span: doc_id, start_word, end_word, n_words, partner_id, first.

    A span is a longest run of words (A-Z in lower case, split at ASCII white space) made up of passages of `least` words or
    more that another document has too; what repeats only inside one document is no span. partner_id is the least id among
    the documents it was found equal to, first tells whether the span's own document has a smaller one. Null, empty and
    shorter texts have no spans. Rows that share an id are documents of their own; a null id (and one of -2^63) is given as null and is never
    first. No rows give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffix")
    source = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    reach = least - seed

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [positions(word_hashes(body.as_py() or b""), seed, least)[1] for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["seed"])

    twice = scratch.write(source.mapInArrow(seeds, "seed long").groupBy("seed").count().where("count > 1"), "twice")
    log = min(filter_log, max(4, (twice.count() * FILTER_BITS >> 6).bit_length()))
    known = spark.sparkContext.broadcast((_filter(twice, log), _levels(twice, block, slot_log)))  # bounded by their parameters

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        bits, levels = known.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]

            def flush() -> pa.RecordBatch:
                joined = lambda c, kind: np.concatenate([*c, np.zeros(0, kind)]).astype(kind)
                ids = pa.array([x for x, n in columns[3] for _ in range(n)], pa.int64())
                sides = []
                for c in columns[5:]:
                    data = np.ascontiguousarray(np.concatenate(c) if c else np.zeros((0, reach), np.uint32)).astype("<u4")
                    sides.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(reach * 4), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary()))
                flat = [joined(columns[0], np.uint64).view(np.int64), joined(columns[1], np.int32), joined(columns[2], np.int64), joined(columns[4], np.int32)]
                for c in columns:
                    c.clear()
                return pa.RecordBatch.from_arrays([*map(pa.array, flat[:3]), ids, pa.array(flat[3]), *sides], names=["seed", "part", "key", "doc_id", "at", "before", "after"])

            held = 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number += 1
                hashes = word_hashes(body.as_py() or b"")
                at, found = positions(hashes, seed, least)
                some = _filtered(found, bits)
                at, found = at[some], found[some]
                if len(at):
                    before, after = _around(hashes, at, seed, reach)
                    key = np.full(len(at), part << 36 | number)
                    level = levels[(found >> np.uint64(64 - slot_log)).astype(np.int64)].astype(np.uint64)
                    dealt = (_mixed(key.astype(np.uint64) * np.uint64(_B) + at.astype(np.uint64)) & ((np.uint64(1) << np.uint64(4) * level) - np.uint64(1))).astype(np.int64)
                    for c, v in zip(columns, (found, np.where(level > 0, dealt, -1), key, (doc, len(at)), at, before, after), strict=True):
                        c.append(v)
                    held += len(at)
                if held > 20_000:
                    yield flush()
                    held = 0
            yield flush()

    suffixes = scratch.write(source.mapInArrow(contexts, _CONTEXT), "suffixes")
    ordered = suffixes.repartition("seed", "part").sortWithinPartitions("seed", "part", "after", "before", "key", "at")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, block):
            yield _compared(rows, seed, least)

    given = ordered.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    compared = scratch.write(given.mapInPandas(compare, _SPAN), "compared")
    edges = compared.where(F.col("kind") != _FOUND)
    ends = edges.groupBy("window").agg(F.min(F.struct("key", "doc_id")).alias("low"), F.max(F.struct("key", "doc_id")).alias("high")).where("low.key <> high.key")
    across = edges.where(F.col("kind") == _WANTED).join(ends, "window").withColumn("partner", F.when(F.col("low.key") == F.col("key"), F.col("high.doc_id")).otherwise(F.col("low.doc_id")))
    spans = ["key", "doc_id", "start", "stop", "partner"]
    found = compared.where(F.col("kind") == _FOUND).select(*spans).unionByName(across.select(*spans))
    order = Window.partitionBy("key").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy("key", "start", "stop").agg(F.first("doc_id").alias("doc_id"), F.min(F.nullif("partner", F.lit(_NO_ID))).alias("partner"))
    begins = (reached.isNull() | (F.col("start") > reached)).cast("int")
    spans = spans.withColumn("_new", begins).withColumn("_span", F.sum("_new").over(order))
    merged = spans.groupBy("key", "_span").agg(F.nullif(F.first("doc_id"), F.lit(_NO_ID)).alias("doc_id"), F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("partner").alias("partner_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id", F.coalesce(F.col("doc_id") < F.col("partner_id"), F.lit(False)).alias("first"))
