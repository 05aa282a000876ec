"""Registered queries of the training-data operators: name -> query, and SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import (
    decontaminate,
    divergence,
    extraction,
    fingerprints,
    mixing,
    quality,
    secret_scan,
    sharding,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from inkprint.llm.common import table
from inkprint.llm.jaccard import near_duplicates
from inkprint.runtime import ship


def op4_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", F.col("n_shingles"), "component_id")


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return query(spark, sf)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: _ready(query)
    for query in (
        fingerprints.op1_merkle_fingerprints,
        quality.op2_quality_classifier,
        toxicity.op3_toxicity_crf,
        op4_ngram_jaccard_join,
        sharding.op5_consistent_hash_shards,
        mixing.op6_subset_sum_mix,
        secret_scan.op7_secret_ownership,
        token_counts.op8_token_counts,
        decontaminate.op9_template_decontamination,
        warc.op10_warc_index_merge,
        divergence.op11_source_divergence,
        whitening.op12_embedding_whitening,
        extraction.op13_nearest_url_extraction,
    )
}
SQL: dict[str, str] = {"op11_source_divergence": divergence.SQL}
