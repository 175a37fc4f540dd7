"""Fill-in-the-middle: texts are cut at two units and put in another order, with markers, so that a model learns to fill gaps.

The matcher is lazy and goes over a text twice: once to count its units, once to the two ranks where it is cut. No list of
units is ever held, so memory beyond a text doesn't depend on how many units it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: A unit: a word with the white space before it, or white space that no word follows.
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those that stay plain are 100 - CUT; of 100 that are cut, SPM have the suffix first.
CUT, SPM, SEED = 50, 80, 42


def count(text: str) -> int:
    """Units of a text, by a first pass."""
    return sum(1 for _ in UNIT.finditer(text))


def ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` and the first `second` units end (first <= second), by a second pass that stops there."""
    units = UNIT.finditer(text)
    at = _end(units, first, 0)
    return at, _end(units, second - first, at)


def _end(units: Iterator[re.Match], steps: int, at: int) -> int:
    """The end of the unit that is `steps` further; `at`, where the last one ended, if there is none to go."""
    last = next(islice(units, steps - 1, steps), None) if steps else None
    return last.end() if last else at


def arrange(text: str, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's and middle's length, output) of a text, given four draws: two ranks, whether to cut, the order."""
    n = count(text)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= CUT:
        return n, "plain", None, None, text
    p, m = ends(text, *sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if draws[3] % 100 < SPM:
        return n, "spm", p, m - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", p, m - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2^32 for a row, from its id alone: the first groups of 8 digits of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """A row for each of docs: row (its columns), n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Draws depend on the seed and the id, so reruns agree and rows that share an id are cut at like ranks; a null id draws as
    an empty one. Null texts are empty. Texts that are empty or hold a marker stay plain, and so does half of the rest.
    Rows stay where they are; docs may have columns of any names; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), draws(F.col(doc_id), seed).alias("draws"))
    added = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [arrange(t, d) for t, d in zip(batch["text"].to_pylist(), batch["draws"].to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row", *added.names])

    return held.mapInArrow(task, T.StructType([held.schema["row"], *added]))


def restored(output: Column, form: Column) -> Column:
    """The text that transform() has arranged, from its output and form alone: markers occur once each, as no cut text holds one."""
    # parts of `<1>a<2>b<3>c`; a marker can't begin inside a part and end in the next marker, so the first found is the one
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    b, c = F.position(second, output), F.position(F.lit(MIDDLE), output)
    one = F.substr(output, F.lit(4), b - 4)
    two = F.substr(output, b + 3, c - b - 3)
    three = F.substr(output, c + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def digests(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    rows = transform(docs, **options)
    key = F.col("row")[options.get("doc_id", "doc_id")]
    return rows.select(key.alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS hex FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
         ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
