"""Context-triggered piecewise hashing: fingerprints of whole texts that stay alike under local edits, and their likeness.

A rolling hash of the last WINDOW code points triggers the end of a chunk where it meets the block size. Each chunk gives one
symbol of a signature. A fingerprint holds the signatures at a block size and at twice that size, so that texts whose
lengths differ by up to about two still have a block size in common; likeness is an edit distance of those signatures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Code points that the rolling hash sees; the least block size; symbols that the block size aims at, those under which it
#: is halved, those of a signature at most (its last chunk takes the rest of the text); code points hashed at once.
WINDOW, LEAST_BLOCK, AIM, FEW, MOST, SLICE = 7, 3, 64, 16, 128, 1 << 18
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A symbol is two digits, 12 bits of a chunk's hash: unrelated texts have few in common by chance.
_PAIRS = [a + b for a in _DIGITS for b in _DIGITS]
_FACTOR, _MIX = 0x01000193, 0x85EBCA6B


def _ends(text: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the chunks that triggers end, whether each is a trigger at twice the block size too), in order.

    The text is hashed in slices, so memory beyond it grows with the chunks alone.
    """
    ends, coarse = [], []
    for at in range(0, len(text), SLICE):
        before = min(WINDOW - 1, at)
        points = np.frombuffer(text[at - before : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        rolling, factor = np.zeros(len(points), np.uint32), np.uint32(1)
        for back in range(min(WINDOW, len(points))):
            rolling[back:] += (points[: len(points) - back] + np.uint32(1)) * factor
            factor = np.uint32(int(factor) * _FACTOR & 0xFFFFFFFF)
        rolling ^= rolling >> np.uint32(15)
        rolling *= np.uint32(_MIX)
        rolling ^= rolling >> np.uint32(13)
        found = np.flatnonzero(rolling[before:] % np.uint32(block) == block - 1)
        ends.append(found + at + 1)
        coarse.append(rolling[before:][found] % np.uint32(2 * block) == 2 * block - 1)
    return (np.concatenate(ends), np.concatenate(coarse)) if ends else (np.zeros(0, np.int64), np.zeros(0, bool))


def _signature(text: str, ends: np.ndarray) -> str:
    """A symbol for each chunk; what follows the last trigger is a chunk too."""
    out, start = [], 0
    for end in [*ends[: MOST - 1].tolist(), len(text)]:
        if end > start:
            out.append(_PAIRS[_crc(text, start, end) & 0xFFF])
        start = end
    return "".join(out)


def _crc(text: str, start: int, end: int) -> int:
    value = 0
    for at in range(start, end, SLICE):
        value = zlib.crc32(text[at : min(at + SLICE, end)].encode("utf-8", "surrogatepass"), value)
    return value


def fingerprint(text: str) -> str:
    """`block:signature:signature at twice the block`. It depends on the whole text and on nothing else; an empty text's is `3::`.

    The block size is the least 3 * 2^k that leaves 64 chunks of that mean length at most; it is halved while a text has
    fewer than 16 chunks, as texts of few different windows do.
    """
    block = LEAST_BLOCK
    while block * AIM < len(text):
        block *= 2
    ends, coarse = _ends(text, block)
    while len(ends) < FEW and block > LEAST_BLOCK:
        block //= 2
        ends, coarse = _ends(text, block)
    return f"{block}:{_signature(text, ends)}:{_signature(text, ends[coarse])}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each symbol of a."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        here = row & at.get(x, 0)
        row = ((row + here) | (row - here)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """1 minus the edit distance of two fingerprints' signatures (insertions and deletions) over their summed lengths.

    Signatures are compared at the least block size that both fingerprints have; where there is none, likeness is 0. Equal
    fingerprints have likeness 1, empty texts among them.
    """
    if a == b:
        return 1.0
    (block, *own), (other, *theirs) = a.split(":"), b.split(":")
    i, j = {0: (0, 0), 1: (0, 1), -1: (1, 0)}.get(_steps(int(block), int(other)), (None, None))
    if i is None:
        return 0.0
    x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (own[i], theirs[j]))
    return 2 * _common(x, y) / (len(x) + len(y)) if x or y else 0.0


def _steps(block: int, other: int) -> int | None:
    """How often block must be halved to be the other: 0, 1 or -1; None if it is neither equal, twice nor half."""
    return {block: 0, block // 2 if block > LEAST_BLOCK else 0: 1, 2 * block: -1}.get(other)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text (null: empty) in a column `out`, which replaces one of that name.

    A row's fingerprint depends on its text alone, so repeated rows have equal ones; no rows give no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t or "") for t in texts], dtype=object)

    return docs.withColumn(out, of(F.col(text)))


def compare(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null where either is null."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else likeness(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return of(a, b)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
#: What a task leaves besides: the texts of its first and of its last row, which meet rows of other tasks.
_FIRST, _LAST = 1, 2


def edited(text: str, other: str) -> str:
    """text with its last half, floor(n / 2) code points, replaced by the first as many (or all) of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _against(doc_id: int | None, text: str, own: str, other: str, others: str) -> tuple:
    changed = edited(text, other)
    print_ = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, others)


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is the one with the next smaller id, null ids last; after the last comes the first. Of rows that share
    an id, that with the smaller XXH64 of its text comes first, and rows that share both are neighbours in any order. A
    table of one row is its own neighbour; no rows give no rows. Null texts are empty; other columns are not read.

    Texts are dealt once, by ranges of (id, hash), and sorted there; a task reads its range as a stream and holds two texts.
    The first and the last text of every range are kept besides and meet afterwards.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctph")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    order = (F.col("doc_id").desc_nulls_last(), F.col("_hash"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "_text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def rows_of(batch: pa.RecordBatch) -> Iterable[tuple]:
            nonlocal held
            for key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(body)
                if held is None:
                    yield (key, *[None] * 6, part, _FIRST, body)
                else:
                    yield (*_against(*held, body, own), part, 0, None)
                held = (key, body, own)

        for batch in batches:
            yield _batch(rows_of(batch))
        if held:
            yield _batch([(held[0], *[None] * 6, part, _LAST, held[1])])

    found = scratch.write(dealt.mapInArrow(task, f"{_RESULT}, _part int, _kind int, _text string"), "ranges")
    firsts = found.where(F.col("_kind") == _FIRST).select(F.col("_part").alias("_next"), F.col("_text").alias("_other"))
    parts = sorted(r[0] for r in firsts.select("_next").collect())  # a number for each task that had rows
    links = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "_part int, _next int")
    ends = found.where(F.col("_kind") == _LAST).select("_part", "doc_id", "_text").join(F.broadcast(links), "_part").join(firsts, "_next")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_against(key, body, fingerprint(body), other, fingerprint(other)) for key, body, other in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(((*r, 0, 0, None) for r in out)).select(range(7))

    names = [x.split()[0] for x in _RESULT.split(", ")]
    return found.where(F.col("_kind") == 0).select(*names).unionByName(ends.select("doc_id", "_text", "_other").mapInArrow(meet, _RESULT))


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 10
    types = (*_TYPES, pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*(x.split()[0] for x in _RESULT.split(", ")), "_part", "_kind", "_text"])
