"""A corpus pipeline of five stages; each works on all rows that its predecessor kept.

1. language_id: documents that no learned language accounts for go.
2. line_dedup: lines that spread over sites go, and documents that are nothing else.
3. simhash_near_dedup: one document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more.
4. source_mixing: documents are repeated, cut or left out so that sources reach their targets.
5. best_fit_packing: the pieces of what is left, with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quietgrid.llm import langid, line_dedup, mixing, near_copies, packing
from quietgrid.llm.common import Scratch, held, release
from quietgrid.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that are in no language: null and letterless texts, and those of which too little is known."""
    ship(spark)
    return langid.accepted(docs)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With cleaned texts; null and empty texts stay as they are, repeated rows are cleaned alike."""
    return line_dedup.strip(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group, one of those that repeat it; wordless texts are a group, null ids come last."""
    ship(spark)
    return near_copies.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; wordless texts go, a null source is a source."""
    return mixing.materialise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every row's text and end id; null text is empty."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_spread),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Language filters, fingerprints and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Every stage's rows are written to the shared folder and read by the next.

    What a stage has kept there besides goes when its rows are written, and its input too. No documents give no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = held()
        after = scratch.write(stage(spark, docs, sf_dir), name)
        release(spark, before)
        if k:
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
