"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagewise.llm.common import ship
from stagewise.llm.decontam import decontaminate
from stagewise.llm.exact import EXACT_SQL, exact_duplicates
from stagewise.llm.html import extract
from stagewise.llm.language import identify
from stagewise.llm.minhash import near_duplicates
from stagewise.llm.packing import pack
from stagewise.llm.quality import quality, quality_sql
from stagewise.llm.ranked import RANKED_SQL, ranked_search
from stagewise.llm.rans import token_files
from stagewise.llm.secrets import scan_secrets
from stagewise.llm.toxicity import score_documents
from stagewise.llm.urls import URLS_SQL, captures_of, filter_urls, journal_of
from stagewise.llm.whiten import whiten

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def tokenizer_file() -> str:
    """The tokenizer of the contracts; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minmax_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))


def op2_dated_url_lists(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages")
    return filter_urls(captures_of(pages), journal_of(pages))


def op3_wrapper_extraction(spark: SparkSession, root: str) -> DataFrame:
    return extract(table(spark, root, "pages"))


def op4_grammar_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return score_documents(table(spark, root, "documents"), table(spark, root, "labels"))


def op5_host_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality(table(spark, root, "documents"))


def op6_crf_secrets(spark: SparkSession, root: str) -> DataFrame:
    return scan_secrets(table(spark, root, "documents"))


def op7_rans_files(spark: SparkSession, root: str) -> DataFrame:
    return token_files(table(spark, root, "documents"), tokenizer_file(), end_id=2, with_ids=False).drop("ids")


def op8_min_slack_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack(table(spark, root, "documents"), tokenizer_file(), end_id=1).drop("ids")


def op9_string_tiling(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op10_centroid_language(spark: SparkSession, root: str) -> DataFrame:
    return identify(table(spark, root, "documents"))


def op11_lanczos_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whiten(table(spark, root, "embeddings"))


def op12_best_position_search(spark: SparkSession, root: str) -> DataFrame:
    return ranked_search(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op13_streaming_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_duplicates(spark, f"{root}/documents.parquet")


SQL: dict[str, str] = {
    "op2_dated_url_lists": URLS_SQL,
    "op5_host_quality": quality_sql(),
    "op12_best_position_search": RANKED_SQL,
    "op13_streaming_dedup": EXACT_SQL,
}

QUERIES: dict[str, Query] = {
    "op1_minmax_dedup": op1_minmax_dedup,
    "op2_dated_url_lists": op2_dated_url_lists,
    "op3_wrapper_extraction": op3_wrapper_extraction,
    "op4_grammar_toxicity": op4_grammar_toxicity,
    "op5_host_quality": op5_host_quality,
    "op6_crf_secrets": op6_crf_secrets,
    "op7_rans_files": op7_rans_files,
    "op8_min_slack_packing": op8_min_slack_packing,
    "op9_string_tiling": op9_string_tiling,
    "op10_centroid_language": op10_centroid_language,
    "op11_lanczos_whitening": op11_lanczos_whitening,
    "op12_best_position_search": op12_best_position_search,
    "op13_streaming_dedup": op13_streaming_dedup,
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        ship(spark)
        return query(spark, root)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(SQL)
