"""Ranked lexical search by Block-Max WAND over an index of compressed posting blocks.

The index is cut into shards of documents. A shard's posting list of a term is a row: blocks of a fixed number of postings,
packed, with the last document and the greatest impact of each block beside them. A search moves shallow pointers over
those block bounds: where the bounds of all lists add up to no more than the k-th score found so far, blocks are passed over
and never unpacked. Shards are searched apart, and their best are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Postings of a block; occurrences of terms after which another shard begins; bytes of a text that are split at once;
#: documents that a search scores together, at first and at most; occurrences of terms of the items that one search job takes.
BLOCK, SHARD, SLICE, SPANS, ITEM_TERMS = 128, 4_000_000, 1 << 20, (256, 4096), 200_000
#: Tasks of a search at most.
TASKS = 1 << 15
#: Of a score: k1 in twelfths of a hundredth, b in hundredths, the scale of an impact.
K1, B, SCALE = 12, 25, 1_000_000_000
#: A-Z become a-z, other ASCII but letters and digits a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = "shard string, term binary, df long, lasts array<int>, maxes array<long>, ends array<int>, packed binary"
_DOCS = "shard string, term binary, doc_ids array<long>, sizes array<long>"


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, with repeats, in lists of bounded size: a term is a run of characters but ASCII ones that are neither letters nor digits."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE) if at + SLICE < len(raw) else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a posting adds to a score, but for its term's weight: (10^9 tf) div (1000 tf + 12 m)."""
    return SCALE * tf // (1000 * tf + K1 * m)


def length_norm(sizes: list[int] | np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """m of documents of so many terms: 100 - 25 + (25 n N) div L, in whole numbers of any size."""
    return np.array([100 - B + B * int(n) * documents // max(occurrences, 1) for n in sizes], np.int64)


def pack(ordinals: np.ndarray, tf: np.ndarray, block_of: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, the end of each) of postings in order; before: the document that each block's gaps begin after.

    A block is a byte of two widths, then its gaps between documents and its counts, each in 1, 2, 4 or 8 little-endian bytes.
    """
    n = np.diff(np.append(starts, len(ordinals)))
    gaps = np.diff(ordinals, prepend=0)
    gaps[starts] = ordinals[starts] - before
    widths = []
    for values in (gaps, tf):
        top = np.maximum.reduceat(values, starts)
        widths.append(np.select([top < 1 << 8, top < 1 << 16, top < 1 << 32], [0, 1, 2], 3))
    sizes = [n << w for w in widths]
    ends = np.cumsum(1 + sizes[0] + sizes[1])
    out = np.zeros(int(ends[-1]), np.uint8)
    begin = ends - (1 + sizes[0] + sizes[1])
    out[begin] = widths[0] << 4 | widths[1]
    place = np.arange(len(ordinals)) - starts[block_of]
    for values, width, base in ((gaps, widths[0], begin + 1), (tf, widths[1], begin + 1 + sizes[0])):
        each = (1 << width)[block_of]
        at = base[block_of] + place * each
        for k in range(8):
            own = each > k
            if not own.any():
                break
            out[at[own] + k] = (values[own] >> (8 * k)) & 255
    return out, ends


def unpack(packed: bytes, begin: int, n: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, counts) of a block of n postings that begins at a byte."""
    wide, narrow = packed[begin] >> 4, packed[begin] & 15
    gaps = np.frombuffer(packed, f"<u{1 << wide}", n, begin + 1)
    tf = np.frombuffer(packed, f"<u{1 << narrow}", n, begin + 1 + (n << wide))
    return before + np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)


class _Shard:
    """Documents under way to a shard of the index: postings as arrays, terms numbered by first occurrence."""

    def __init__(self, name: str):
        self.name, self.terms, self.parts = name, {}, []
        self.ids, self.sizes, self.seen = [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        counts, size = Counter(), 0
        for found in term_lists(text):
            counts.update(found)
            size += len(found)
        if not size:
            return
        terms = self.terms
        own = np.fromiter((terms.setdefault(t, len(terms)) for t in counts), np.int64, len(counts))
        self.parts.append((own, np.full(len(own), len(self.ids)), np.fromiter(counts.values(), np.int64, len(counts))))
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.seen += size

    def tables(self, documents: int, occurrences: int, block: int) -> Iterator[pa.RecordBatch]:
        """The shard's rows of the index, by term, after a row of its documents. Documents are numbered by ascending id, null ids last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, sizes = [self.ids[i] for i in order], [self.sizes[i] for i in order]
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        term, doc, tf = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        term, doc = rank[term], place[doc]
        by = np.argsort(term * len(ids) + doc, kind="stable")
        term, doc, tf = term[by], doc[by], tf[by]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(np.append(first, len(term)))
        blocks = -(-df // block)
        of_term = np.repeat(np.arange(len(df)), blocks)
        nth = np.arange(len(of_term)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = first[of_term] + nth * block
        block_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
        lasts = doc[np.append(starts[1:], len(doc)) - 1]
        before = np.where(nth == 0, -1, np.roll(lasts, 1))
        maxes = np.maximum.reduceat(impacts(tf, length_norm(sizes, documents, occurrences)[doc]), starts)
        packed, ends = pack(doc, tf, block_of, starts, before)
        at = np.append(0, np.cumsum(blocks))
        bytes_at = np.append(0, ends[at[1:] - 1])
        ends = ends - np.repeat(bytes_at[:-1], blocks)
        lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(a, kind))
        data = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(packed)])
        columns = [pa.array([self.name] * len(df)), pa.array(names, pa.binary()), pa.array(df, pa.int64()), lists(lasts, pa.int32()), lists(maxes, pa.int64()), lists(ends, pa.int32()), data]
        none = [pa.nulls(len(df), pa.list_(pa.int64()))] * 2
        kinds = [c.type for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([self.name]), *(pa.nulls(1, k) for k in kinds[1:]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))], names=_NAMES)
        yield from pa.Table.from_arrays(columns + none, names=_NAMES).to_batches(max_chunksize=10_000)


_HITS = pa.schema([("_item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_NAMES = ["shard", "term", "df", "lasts", "maxes", "ends", "packed", "doc_ids", "sizes"]


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, occurrences of terms in all of them)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sum(map(len, term_lists(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["documents", "occurrences"])

    row = docs.select(text).mapInArrow(task, "documents long, occurrences long").agg(F.sum("documents"), F.sum("occurrences")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The index of all terms of all documents, written to the shared folder: a row for each shard and term, and one for its documents.

    Texts are read twice, once for the totals that impacts depend on, and are not shuffled: a task makes shards of what it
    reads. It holds one shard's postings, and splits long texts piece by piece. A document without a term is in no list, nor
    is a null text. Rows that share an id are documents of their own.
    """
    documents, occurrences = totals(docs, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, part = 0, TaskContext.get().partitionId()
        now = _Shard(f"{part}-{made}")
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now.add(key, body)
                if now.seen >= shard:
                    yield from now.tables(documents, occurrences, block)
                    made += 1
                    now = _Shard(f"{part}-{made}")
        if now.ids:
            yield from now.tables(documents, occurrences, block)

    index = scratch.write(docs.select(F.col(doc_id).cast("long"), text).mapInArrow(task, f"{_INDEX}, doc_ids array<long>, sizes array<long>"), "index")
    index.totals = (documents, occurrences)
    return index


class _List:
    """A shard's posting list of a term. Blocks are unpacked when a search first needs them, and kept for the shard's other searches."""

    def __init__(self, df, lasts, maxes, ends, packed, norm: np.ndarray, block: int):
        self.df, self.block, self.packed, self.norm = df, block, packed, norm
        self.lasts, self.maxes, self.ends = (np.asarray(a, np.int64) for a in (lasts, maxes, ends))
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if i not in self.unpacked:
            n = min(self.block, self.df - i * self.block)
            docs, tf = unpack(self.packed, int(self.ends[i - 1]) if i else 0, n, int(self.lasts[i - 1]) if i else -1)
            self.unpacked[i] = docs, impacts(tf, self.norm[docs])
        return self.unpacked[i]


def best(lists: list[tuple[_List, int]], k: int, spans: tuple[int, int] = SPANS) -> tuple[list[tuple[int, int]], int]:
    """((score, document) of the k best, ties to the smaller number; blocks that were unpacked) by Block-Max WAND.

    lists: posting lists and the weights of their terms. Documents fall into stretches, in which no list's pointer moves on:
    stretches end where a block ends and, for lists of a single block, before and at each posting. So one bound, the sum of
    the greatest impacts under the pointers, holds for a whole stretch. The pivot is the next stretch whose bound exceeds the
    k-th score so far. Stretches up to there are passed by shallow moves; from there some documents are scored, and of their
    blocks only those are unpacked that lie under stretches with a sufficient bound. As documents come in ascending order,
    one that only equals the k-th score can't displace it, so nothing is lost.
    """
    lists = [(x, w) for x, w in lists if w > 0]
    if not lists:
        return [], 0
    looked = {(i, 0) for i, (x, _) in enumerate(lists) if len(x.lasts) == 1}
    marks = []
    for x, _ in lists:
        marks += [x.lasts] if len(x.lasts) > 1 else [x.postings(0)[0], x.postings(0)[0] - 1]
    stretch = np.unique(np.concatenate(marks))
    stretch = stretch[stretch >= 0]
    bound, shallow = np.zeros(len(stretch), np.int64), []
    for x, w in lists:
        if len(x.lasts) > 1:
            at = np.searchsorted(x.lasts, stretch)  # the block that each stretch lies in; past the last one there is none
            bound += w * np.append(x.maxes, 0)[at]
        else:
            docs, impact = x.postings(0)
            own = np.searchsorted(stretch, docs)
            at = np.ones(len(stretch), np.int64)
            at[own] = 0
            bound[own] += w * impact
        shallow.append(at)
    found: list[tuple[int, int]] = []
    least, at, span = 0, 0, spans[0]
    while True:
        rest = np.flatnonzero(bound[at:] > least)
        if not len(rest):
            break
        pivot = at + int(rest[0])
        begin = int(stretch[pivot - 1]) + 1 if pivot else 0
        to = max(pivot + 1, int(np.searchsorted(stretch, begin + span)))
        worth = pivot + np.flatnonzero(bound[pivot:to] > least)
        scores = np.zeros(int(stretch[to - 1]) + 1 - begin, np.int64)
        for i, ((x, w), own) in enumerate(zip(lists, shallow, strict=True)):
            blocks = np.unique(own[worth])
            for j in blocks[blocks < len(x.lasts)].tolist():
                docs, impact = x.postings(j)
                looked.add((i, j))
                lo, hi = np.searchsorted(docs, (begin, begin + len(scores)))
                scores[docs[lo:hi] - begin] += w * impact[lo:hi]
        # a document in another stretch may have a part of its score only, which its bound, so the k-th score, is no less than
        hits = np.flatnonzero(scores > least)
        if len(hits):
            order = hits[np.lexsort((hits, -scores[hits]))][:k]
            found = sorted([*found, *zip((-scores[order]).tolist(), (order + begin).tolist(), strict=True)])[:k]
            if len(found) == k:
                least = -found[-1][0]
        at, span = to, min(2 * span, spans[1])
    return [(-s, d) for s, d in found], len(looked)


def _terms(text: Column) -> Column:
    """The terms of a text as an array of strings, in SQL functions."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != "")


def search(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores over 0 of each row of items, ties to the smaller doc_id (null last).

    An item's repeated terms count as often as they occur. Items are taken in blocks of some ITEM_TERMS terms, each block a
    job over all shards; a block's terms go to all tasks, so its size bounds what is broadcast. Of the index only the lists of
    a block's terms are shuffled, by shard. Items that share an id are ranked each, so their ranks repeat; a null or empty
    text has no rows, nor has any item over an empty index. Rows of equal score and id may come in any order.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "wand")
    documents, occurrences = index.totals
    wanted = items.select(F.col(item_id).alias("item_id"), F.monotonically_increasing_id().alias("_item"), _terms(F.col(text)).alias("_terms")).where(F.size("_terms") > 0)
    wanted = scratch.write(wanted, "items")
    size = wanted.agg(F.sum(F.size("_terms"))).first()[0] or 0
    jobs, shards = -(-size // ITEM_TERMS), index.where(F.col("doc_ids").isNotNull()).count()
    wanted = wanted.withColumn("_job", F.pmod(F.xxhash64("_item"), F.lit(max(jobs, 1))))
    found = []
    for job in range(jobs):
        own = wanted.where(F.col("_job") == job)
        terms = own.select("_item", F.explode("_terms").alias("_term")).groupBy("_item", F.encode("_term", "UTF-8").alias("term")).agg(F.count("*").alias("n"))
        terms = scratch.write(terms, "terms")  # of one job: some ITEM_TERMS rows at most
        lists = index.join(F.broadcast(terms.select("term").distinct()), "term")
        weights = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
        asked = terms.join(weights, "term").groupBy("_item").agg(F.collect_list(F.struct("term", (F.col("n") * F.col("w")).alias("w"))).alias("terms"))
        queries = {r["_item"]: [(bytes(t["term"]), t["w"]) for t in r["terms"]] for r in asked.collect()}  # of one job
        rows = lists.select(*index.columns).unionByName(index.where(F.col("doc_ids").isNotNull()))
        # shards are work of like size, however little their lists hold, so tasks aren't joined by bytes
        found.append(rows.repartition(max(1, min(shards, TASKS)), "shard").groupBy("shard").applyInArrow(_searcher(queries, documents, occurrences, k, block), "_item long, doc_id long, score long"))
    if not found:
        return wanted.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(wanted.select("item_id", "_item"), "_item").select("item_id", "rank", "doc_id", "score")


def _searcher(queries: dict[int, list[tuple[bytes, int]]], documents: int, occurrences: int, k: int, block: int):
    """A function from a shard's rows to the best documents of each query."""

    def run(rows: pa.Table) -> pa.Table:
        lists, ids, norm = {}, [], None
        columns = [rows[n] for n in ("term", "df", "lasts", "maxes", "ends", "packed", "doc_ids", "sizes")]
        parts = list(zip(*(c.combine_chunks() if len(c) else c for c in columns), strict=True))
        for *_, own, sizes in parts:
            if own.is_valid:
                ids, norm = own.as_py(), length_norm(sizes.as_py(), documents, occurrences)
        for term, df, lasts, maxes, ends, packed, own, _ in parts:
            if not own.is_valid:
                lists[term.as_py()] = _List(df.as_py(), lasts.values, maxes.values, ends.values, packed.as_py(), norm, block)
        out = []
        for item, terms in queries.items():
            hits, _ = best([(lists[t], w) for t, w in terms if t in lists], k)
            out += [(item, ids[d], s) for s, d in hits]
        return pa.table(list(zip(*out, strict=True)) or [[]] * 3, schema=_HITS)

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Builds the index of docs and searches it for items; see build() and search()."""
    return search(build(docs, Scratch(docs.sparkSession, "index")), items, k)


SQL = r"""
WITH t AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
p AS (SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT rid, sum(tf) AS n FROM p GROUP BY rid),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
m AS (SELECT rid, 100 - 25 + (25 * n::BIGINT * docs) // total AS m FROM d, g),
q AS (
  SELECT iid, item_id, term, count(*) AS qtf
  FROM (SELECT iid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT *, row_number() OVER () AS iid FROM benchmark)) GROUP BY ALL),
s AS (
  SELECT iid, item_id, p.rid, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m ON m.rid = p.rid GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""
