"""A corpus pipeline of four stages: quality rules, near duplicates, personal data, packing.

Each stage works on all that the one before has kept. ``run`` writes every stage's rows as Parquet in
the shared folder and reads them back as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.jaccard_join import surplus_rows
from spanloom.llm.packing import pack
from spanloom.llm.pii import redact
from spanloom.llm.quality import keeps
from spanloom.llm.store import bounded_batches, materialize

#: Near duplicates share this part of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded_batches(spark)
    return docs.where(keeps(docs)("text", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id (nulls last), then text digest.

    Rows are told apart by doc_id and text, so that a doc_id may stand for several texts. Documents without
    words stay. Of rows that share a doc_id and a text, one stays.
    """
    bounded_batches(spark)
    surplus, repeated = surplus_rows(docs, shingle=SHINGLE, percent=PERCENT)
    same = lambda rows: docs["doc_id"].eqNullSafe(rows["doc_id"]) & (F.md5(docs["text"]) == rows["digest"])
    kept = docs.join(surplus, same(surplus), "left_anti")
    if not repeated.limit(1).count():
        return kept
    once, again = kept.join(repeated, same(repeated), "left_anti"), kept.join(repeated, same(repeated), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in place of every personal identifier."""
    bounded_batches(spark)
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens, sources mixed by their shares."""
    bounded_batches(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL can express neither the graph of patterns nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
