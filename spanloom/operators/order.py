"""Filters with reasons, orders of work and samples, dedup of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason, in order, whose condition holds; null if none does."""
    out = F.when(F.lit(False), "")
    for name, condition in reasons.items():
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out


def inventory_reason(start: Column, end: Column, duration: Column, in_chapter: Column, floor: float = 2.0, margin: float = 3.0) -> Column:
    """Why a span is no sound inventory: tooShort, tooEarly, tooLate, contentChapter, or null."""
    return first_reason({"tooShort": ~F.coalesce(end - start >= floor, F.lit(False)), "tooEarly": end <= margin, "tooLate": (duration > 0) & (start >= duration - margin), "contentChapter": in_chapter})


def precision_class(start: Column, end: Column, score: Column, duration: Column, signals: Column, ui: float = 0.40, auto: float = 0.70, low: float = 30.0, high: float = 90.0) -> Column:
    """detectionOnly, uiCandidate:<reason> or autoSkipEligible. ``signals`` is an array; a catalogue match alone is not enough."""
    bad = ~(F.coalesce((start >= 0) & (end > start) & score.between(0, 1) & ((duration == 0) | (end <= duration)), F.lit(False)))
    alone = F.size(F.array_except(signals, F.array(F.lit("catalogMatch")))) == 0
    return F.when(bad | (score < ui), "detectionOnly").when(score < auto, "uiCandidate:belowAutoSkipThreshold").when(~(end - start).between(low, high), "uiCandidate:durationImplausible").when(alone, "uiCandidate:noSafetySignals").otherwise("autoSkipEligible")


def primary_cause(rows: DataFrame, keys: Sequence[str], cause: str, tiers: dict[str, int]) -> DataFrame:
    """Each key's cause of the highest tier (ties to the one named first), and how many others there are."""
    names = list(tiers)
    tier = F.coalesce(*(F.when(F.col(cause) == c, F.lit(t)) for c, t in tiers.items()), F.lit(-1))
    place = F.coalesce(*(F.when(F.col(cause) == c, F.lit(i)) for i, c in enumerate(names)), F.lit(len(names)))
    best = rows.groupBy(*keys).agg(F.min(F.struct((-tier).alias("t"), place.alias("i"), F.col(cause).alias("c")))["c"].alias("primary"), (F.countDistinct(cause) - 1).alias("secondary"))
    return best


def reprioritized(jobs: DataFrame, order: Sequence[Column], capacity: int, ceiling: int = 9) -> DataFrame:
    """The first ``capacity`` jobs with new priorities ceiling, ceiling - 1, ... 1: a top-k, so no full sort reaches one task."""
    top = jobs.orderBy(*order).limit(capacity)
    place = F.row_number().over(Window.orderBy(*order))  # ``capacity`` rows at most
    return top.withColumn("priority", F.greatest(F.lit(1), ceiling - place + 1))


def first_mid_last(rows: DataFrame, keys: Sequence[str], opening: float, middle: float, closing: float) -> DataFrame:
    """Rows (start, end) in a key's opening, closing and, if it is long enough, middle stretch."""
    ends = rows.groupBy(*keys).agg(F.min("start").alias("_a"), F.max("end").alias("_z"))
    half = (F.col("_a") + F.col("_z")) / 2
    long = F.col("_z") - F.col("_a") > opening + middle + closing
    inner = long & (F.col("end") > half - middle / 2) & (F.col("start") < half + middle / 2)
    return rows.join(ends, list(keys)).where((F.col("start") < F.col("_a") + opening) | (F.col("end") > F.col("_z") - closing) | inner).drop("_a", "_z")


def coverage_plan(observed: Column, recall: Column, since_full: Column, least: int = 5, stable: float = 0.9, every: int = 10) -> Column:
    """full until enough is observed or while recall is low, periodicFull every so often, else targeted."""
    return F.when((observed < least) | (recall < stable), "full").when(since_full >= every, "periodicFull").otherwise("targeted")


def stratified(rows: DataFrame, strata: Sequence[str], id_column: str, seed: str, each: int) -> DataFrame:
    """The ``each`` rows of every stratum with the least salted digests: a partial top-k by stratum and range of digests, then a final one."""
    h = F.sha2(F.concat(F.lit(seed), F.col(id_column).cast("string")), 256)
    hashed = rows.withColumn("_h", h).withColumn("_r", F.pmod(F.xxhash64(id_column), F.lit(64)))
    rank = lambda df, *k: df.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy("_h", id_column))).where(F.col("_n") <= each)
    return rank(rank(hashed, *strata, "_r"), *strata).drop("_h", "_r", "_n")


def next_jobs(jobs: DataFrame, now: Column, deferred_allowed: bool) -> DataFrame:
    """Jobs that may run now: playback jobs below their coverage, others only if deferred work is allowed."""
    ready = (F.col("lane") == "playback") & (F.col("coverage") < F.col("wanted")) | ((F.col("lane") != "playback") & F.lit(deferred_allowed))
    return jobs.where(ready & (F.col("eligible_at") <= now))


def first_arrivals(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert or ignore: of rows with one key the first to arrive, as a running minimum."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *rest)).alias("_f"))
    return first.select(*keys, *(F.col(f"_f.{c}").alias(c) for c in rest))


def correction_key(kind: Column, start: Column, end: Column) -> Column:
    """Kind and times on a grid of tenths of a second."""
    grid = lambda t: F.format_number(F.round(t, 1), "0.0")
    return F.concat_ws(":", kind, grid(start), grid(end))


def unsubsumed(phrases: DataFrame, key: str, phrase: str, support: str) -> DataFrame:
    """Phrases that no longer phrase contains whose support is at least half theirs. Parts of the longer ones are joined, all pairs are not."""
    words = F.split(phrase, " ")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    parts = phrases.where(n > 1).select(F.explode(F.array_distinct(spans)).alias(phrase), F.col(support).alias("_s")).groupBy(phrase).agg(F.max("_s").alias("_s"))
    return phrases.join(parts, phrase, "left").where(F.col("_s").isNull() | (2 * F.col("_s") < F.col(support))).drop("_s")
