"""Streaming forms of gap groups and counters; the same functions work on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: Sequence[str], at: str = "ts", gap: str = "6 hours", late: str = "1 minute") -> DataFrame:
    """Sessions of events less than ``gap`` apart: keys, start, end (last event), n. Rows later than ``late`` are dropped from streams."""
    grouped = events.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("_w"))
    return grouped.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_w")


def windowed_counts(events: DataFrame, keys: Sequence[str], at: str = "ts", window: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """Counts by key and window; only additive state, so late rows within ``late`` are merged in."""
    return events.withWatermark(at, late).groupBy(*keys, F.window(at, window).alias("_w")).agg(F.count("*").alias("n")).select(*keys, F.col("_w.start").alias("start"), "n")
