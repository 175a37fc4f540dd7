"""Packing token sequences by minimum bin slack.

Documents become token ids, are cut only where they exceed the capacity, and the pieces are packed into bins. The packer
works on the histogram of piece lengths, which has at most `capacity` rows however large the corpus is: for each bin it
puts in the longest piece left and a bitset subset-sum dynamic program over the lengths still available finds the fullest
combination for the rest. The combination is then removed, as many times as its pieces last, so the whole plan takes a few
thousand programs. Pieces get their places from their rank among pieces of equal length, which tasks count on their own.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY, END_ID = 2048, 0
#: Words that a worker keeps encoded (as many letter runs again, and some of what follows them), the longest such word in
#: bytes, the misses after which it starts afresh, and the bytes of text encoded at once.
CACHED, CACHED_TAILS, CACHED_BYTES, MISSES, CHUNK_BYTES = 200_000, 10_000, 48, 4_000_000, 1 << 20
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, nth long"


class _Words:
    """Encodes words and keeps the common ones: those seen first, until too many others were met.

    Most words are letters and then punctuation, and the tokenizer splits them there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.runs, self.tails, self.misses = Tokenizer.from_file(path), {}, {}, {}, 0
        self.model = self.tokenizer.model
        self.bytes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)]

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: bytes) -> bytes | None:
        """The ids of a run of lower-case letters; None if it isn't one, or if the normaliser changes it."""
        if run.isalpha():  # ASCII letters stand for their own bytes, so the model takes them as they are
            return b"".join([self.bytes[x.id] for x in self.model.tokenize(run.decode())])
        if not run.isascii() and unicodedata.normalize("NFC", run.decode("utf-8", "replace")).lower().isalpha():
            return self._one(run)
        return None

    def _new(self, words: set[bytes]) -> dict[bytes, bytes]:
        out, new, runs, tails = {}, {}, self.runs, self.tails
        for word in words:
            run = word.lower().rstrip(_MARKS)
            ids = runs.get(run) or new.get(run)
            if ids is None:
                if (ids := self._run(run)) is None:
                    out[word] = self._one(word)
                    continue
                new[run] = ids
            if len(run) != len(word):
                tail = word[len(run) :]
                if tail not in tails:
                    if len(tails) >= CACHED_TAILS:
                        tails.clear()
                    tails[tail] = self._one(tail)
                ids += tails[tail]
            out[word] = ids
        if len(runs) < CACHED:
            runs.update((w, x) for w, x in new.items() if len(w) <= CACHED_BYTES)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Token ids of UTF-8 texts as little-endian unsigned 32-bit integers, without special tokens."""
        if self.misses > MISSES:
            self.known.clear()
            self.runs.clear()
            self.misses = 0
        split, known = [t.split() for t in texts], self.known
        missing = set().union(*split).difference(known)
        new, full = self._new(missing) if missing else {}, len(known) >= CACHED
        known.update(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new if full else [w for w in new if len(w) > CACHED_BYTES]:
            del known[word]
        self.misses += len(missing)
        return out


_words = cache(_Words)


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids of each text. The tokenizer never joins what ASCII white space separates, so words are encoded apart."""
    return _words(path).encode(texts)


def _chunks(rows: Iterator[tuple], most: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) of rows, of `most` bytes of text or one row."""
    keys, texts, size = [], [], 0
    for key, body in rows:
        if texts and size + len(body) > most:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(body)
        size += len(body)
    if texts:
        yield keys, texts


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its task's number and count among equal lengths."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), [0] * (capacity + 1)
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            texts = ((key, body.as_py() or b"") for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            coded = (pair for keys, bodies in _chunks(texts) for pair in zip(keys, encode(bodies, tokenizer), strict=True))
            for key, ids in coded:
                view = memoryview(ids := ids + end)
                for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = view[start * 4 : (start + capacity) * 4]
                    length = len(own) // 4
                    for column, value in zip(rows, (part, key, n, start, length, zlib.crc32(own), counts[length]), strict=True):
                        column.append(value)
                    counts[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(pieces, _PIECES)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths [(length, uses)] with the largest sum up to room; long pieces are preferred among equals."""
    reach, steps, full, mask = 1, [], 1 << room, (2 << room) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, unit = min(counts[length], room // length), 1
        while left and not reach & full:
            unit = min(unit, left)
            steps.append((length, unit, reach))
            reach |= (reach << (unit * length)) & mask
            left, unit = left - unit, unit * 2
        if reach & full:
            break
    total, uses = reach.bit_length() - 1, {}
    for length, unit, before in reversed(steps):
        if not before >> total & 1:
            uses[length] = uses.get(length, 0) + unit
            total -= unit * length
    return list(uses.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination [(length, uses)], bins that hold it)], which together use every piece of the histogram once."""
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        uses = dict(fullest({k: n for k, n in rest.items() if n}, capacity - longest))
        uses[longest] = uses.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in uses.items())
        out.append((sorted(uses.items(), reverse=True), bins))
        for k, n in uses.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return out


def _places(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """By length and rank: the first rank of each run, the uses in a bin, the run's first bin and place in it."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for uses, n in bins:
        at = 0
        for length, k in uses:
            rows.append((length, rank.get(length, 0), k, base, at))
            rank[length] = rank.get(length, 0) + k * n
            at += k * length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 48) + table[:, 1], "from": table[:, 1], "uses": table[:, 2], "bin": table[:, 3], "at": table[:, 4]}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and an end id; null text is empty, so it is the end id alone. Only documents over the
    capacity are cut. Offsets in a sequence are gapless from 0. Null and repeated ids are packed like others, one set of
    pieces per row; other columns are not read; no rows give no rows. The plan is held by the driver and sent to the tasks:
    it has at most `capacity` lengths and, for each combination, at most sqrt(2 * capacity) of them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut(docs, tokenizer, capacity, doc_id, text), "pieces")
    # a full piece is a sequence of its own: odd numbers; packed sequences have even ones
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.expr("(shiftleft(cast(part as bigint), 40) + nth) * 2 + 1")).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)
    counts = scratch.write(short.groupBy("part", "length").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = short.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)).astype(np.int64) for k in ("length", "rank"))
            row = np.searchsorted(known["key"], (length << 48) + rank, "right") - 1
            q = rank - known["from"][row]
            sequence = (known["bin"][row] + q // known["uses"][row]) * 2
            offset = known["at"][row] + q % known["uses"][row] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*keep, "rank").mapInArrow(place, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
    return full.select(*keep, "sequence_id", "offset").unionByName(placed).withColumn("length", F.col("length").cast("long"))
