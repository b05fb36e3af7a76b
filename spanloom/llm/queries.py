"""Registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.byte_bpe import byte_bpe
from spanloom.llm.hnsw import every_nth, nearest
from spanloom.llm.jaccard_join import jaccard_components
from spanloom.llm.kmeans import clusters
from spanloom.llm.packing import pack
from spanloom.llm.periodic import periodic_runs
from spanloom.llm.pfor import token_files
from spanloom.llm.pii import find_pii
from spanloom.llm.quality import quality
from spanloom.llm.secrets import find_secrets
from spanloom.llm.store import bounded_batches
from spanloom.llm.substrings import substring_dedup
from spanloom.llm.token_counts import token_counts
from spanloom.llm.warc import archived_and_audited


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_and_audited(_table(spark, sf_dir, "pages"))


def op3_hnsw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows.where(every_nth(rows, 20)), rows, k=20)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(_table(spark, sf_dir, "documents"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_warc_fixity": op2_warc_fixity,
        "op3_hnsw_nearest": op3_hnsw_nearest,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_mixture_packing": op5_mixture_packing,
        "op6_pii_bootstrap": op6_pii_bootstrap,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_secret_ownership": op8_secret_ownership,
        "op9_quality_divergence": op9_quality_divergence,
        "op10_token_files": op10_token_files,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    from spanloom.llm import oracles

    return oracles.oracle_sql()
