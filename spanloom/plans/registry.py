"""All registered queries of the library, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans import alignment_queries, evaluation_queries, event_queries, feature_queries, feed_queries, fingerprint_queries, join_queries, motif_queries, order_queries, profile_queries, rollup_queries, score_queries, slot_queries, snapshot_queries, table_queries, text_queries

_MODULES = (event_queries, table_queries, score_queries, join_queries, rollup_queries, feature_queries, text_queries, order_queries, evaluation_queries, fingerprint_queries, alignment_queries, feed_queries, motif_queries, profile_queries, slot_queries, snapshot_queries)

FLAGSHIP = "ivl_merge_events"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
