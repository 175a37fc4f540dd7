"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import ctph, embed_dedup, fim, langid, line_dedup, mixing, mtree, packing, simhash, suffix_dedup, url_filter, wand, warc_zip
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(ship(spark), sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(ship(spark), sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(ship(spark), sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(ship(spark), sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(ship(spark), sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(ship(spark), sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(ship(spark), sf_dir, "documents"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(ship(spark), sf_dir, "pages"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.against_next(table(ship(spark), sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(ship(spark), sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.rank(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_url_filter": op4_url_filter,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_warc_zip": op10_warc_zip,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL, where it can express a query. The others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": mtree.SQL,
    "op4_url_filter": url_filter.SQL,
    "op6_source_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_warc_zip": warc_zip.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_ranked_search": wand.SQL,
}
