"""Cohorts, counters, stores and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suppressed_rollup(rows: DataFrame, cohort: Sequence[str], member: str, sums: Sequence[str], k: int = 20) -> DataFrame:
    """Sums over every prefix of the cohort columns; cells of fewer than ``k`` members show none."""
    cells = rows.rollup(*cohort).agg(F.countDistinct(member).alias("members"), *(F.sum(s).alias(s) for s in sums))
    return cells.select(*cohort, "members", *(F.when(F.col("members") >= k, F.col(s)).alias(s) for s in sums))


def counter_merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per cell the larger of two counters."""
    return a.withColumnRenamed("n", "_a").join(b.withColumnRenamed("n", "_b"), key, "full").select(key, F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).alias("n"))


def counter_delta(total: DataFrame, watermark: DataFrame, key: str) -> DataFrame:
    """What each counter has gained since the watermark; cells without gain are left out."""
    both = total.join(watermark.withColumnRenamed("n", "_w"), key, "left").withColumn("delta", F.col("n") - F.coalesce("_w", F.lit(0)))
    return both.where("delta > 0").select(key, "delta")


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """What least-recently-used eviction leaves: the ``cap`` first rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def spread(rows: DataFrame, entity: str, place: str, at: str, share: float, places: int, days: int) -> DataFrame:
    """Entities seen in enough places over enough days: entity, n_places, ratio, days."""
    total = rows.agg(F.countDistinct(place).alias("total"))
    seen = rows.groupBy(entity).agg(F.countDistinct(place).alias("n_places"), F.datediff(F.max(at), F.min(at)).alias("days"))
    ratio = F.round(F.col("n_places") / F.col("total"), 6)
    return seen.join(F.broadcast(total)).withColumn("ratio", ratio).where((F.col("ratio") >= share) & (F.col("n_places") >= places) & (F.col("days") >= days)).select(entity, "n_places", "ratio", "days")


def trimmed(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Least and largest value and count, without the outer share on each side (one at least, from four rows on)."""
    cut = F.when(F.col("_n") >= 4, F.greatest(F.lit(1), F.floor(F.col("_n") * share))).otherwise(0)
    ranked = distributed_rank(rows.where(F.col(value).isNotNull()), keys, value)
    kept = ranked.where((F.col("_rank") > cut) & (F.col("_rank") <= F.col("_n") - cut))
    return kept.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))


def audit_sample(rows: DataFrame, keys: Sequence[str], id_column: str, rate: float, seed: str, least: float = 0.10, most: float = 0.15) -> DataFrame:
    """A share of each key's rows by the rank of a salted SHA-256: count = round(n * rate) within bounds, one at least.

    Rows are ranked within 4096 ranges of the digest, behind the counts of the ranges before, so no key is sorted as a whole.
    """
    low = F.greatest(F.lit(1), F.ceil(F.col("_n") * least))
    wanted = F.greatest(low, F.least(F.greatest(low, F.floor(F.col("_n") * most)), F.round(F.col("_n") * rate).cast("long")))
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(id_column).cast("string")), 256)).withColumn("_range", F.substring("_h", 1, 3))
    counts = hashed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    order, whole = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    placed = counts.select(*keys, "_range", (F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_h", id_column))
    some = hashed.join(placed, [*keys, "_range"]).where(F.col("_before") < wanted).withColumn("rank", (F.col("_before") + inside).cast("int"))
    return some.where(F.col("rank") <= wanted).drop("_h", "_range", "_before", "_n")


def retention(days: DataFrame, user: str, day: str, rungs: Sequence[int]) -> DataFrame:
    """Users, and how many of them come back a rung of days or more after their first day."""
    first = days.groupBy(user).agg(F.min(day).alias("_f"), F.max(day).alias("_l"))
    gap = F.datediff("_l", "_f")
    return first.agg(F.count("*").alias("users"), *(F.sum((gap >= r).cast("long")).alias(f"d{r}") for r in rungs))


def weighted_share(rows: DataFrame, entity: str, place: str, frequency: str, weight: str, least: int = 2) -> DataFrame:
    """Weighted mean frequency over all places' weight, for entities of enough places."""
    total = rows.select(place, weight).distinct().agg(F.sum(weight).alias("_w"))
    each = rows.groupBy(entity).agg(F.sum(F.col(frequency) * F.col(weight)).alias("_s"), F.countDistinct(place).alias("n_places"))
    return each.where(F.col("n_places") >= least).join(F.broadcast(total)).select(entity, "n_places", F.round(F.col("_s") / F.col("_w"), 6).alias("share"))


def distributed_rank(rows: DataFrame, keys: Sequence[str], value: str, bins: int = 4096) -> DataFrame:
    """``_rank`` (from 1, ties in any order) and ``_n`` of each key's rows by value, without gathering a key.

    Values are cut into bins between the key's least and largest one; a bin's rows are ranked by themselves, behind
    the counts of the bins before it.
    """
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    binned = rows.join(ends, list(keys)).withColumn("_bin", place)
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c")).select(*keys, "_bin", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value))
    return binned.join(counts, [*keys, "_bin"]).withColumn("_rank", F.col("_before") + inside).drop("_bin", "_lo", "_hi", "_before")


def duration_range(rows: DataFrame, keys: Sequence[str], value: str, share: float = 0.1, width: float = 10.0) -> DataFrame:
    """low and high of the trimmed values, at least ``width`` apart around their middle."""
    kept = trimmed(rows, keys, value, share)
    middle, narrow = (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low") < width
    return kept.select(*keys, F.when(narrow, middle - width / 2).otherwise(F.col("low")).alias("low"), F.when(narrow, middle + width / 2).otherwise(F.col("high")).alias("high"), "n")


def clusters(rows: DataFrame, keys: Sequence[str], value: str, weight: str, radius: float) -> DataFrame:
    """Greedy clusters of values on a line, in ascending order: keys, centroid, weight.

    Rows of one value are summed up first, so that what is folded is a key's distinct values, not its rows.
    """
    distinct = rows.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.sum(weight).cast("double").alias("_w"))
    points = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_w").alias("w")))).alias("_p"))
    # the last place is the first cluster within the radius, or the end
    at = lambda acc, p: F.coalesce(F.array_min(F.filter(F.transform(acc, lambda c, i: F.when(F.abs(c["x"] - p["x"]) <= radius, i)), lambda i: i.isNotNull())), F.lit(-1))
    joined = lambda c, p: F.struct(((c["x"] * c["w"] + p["x"] * p["w"]) / (c["w"] + p["w"])).alias("x"), (c["w"] + p["w"]).alias("w"))
    step = lambda acc, p: F.when(at(acc, p) < 0, F.concat(acc, F.array(p))).otherwise(F.transform(acc, lambda c, i: F.when(i == at(acc, p), joined(c, p)).otherwise(c)))
    found = points.select(*keys, F.aggregate("_p", F.array().cast("array<struct<x:double,w:double>>"), step).alias("c"))
    return found.select(*keys, F.explode("c").alias("c")).select(*keys, F.col("c.x").alias("centroid"), F.col("c.w").alias("weight"))


def running_spread(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and spread as one-at-a-time updates give them: a first spread of 2, none below .1."""
    spread = F.when(F.count(value) > 1, F.greatest(F.stddev_samp(value), F.lit(0.1))).otherwise(2.0)
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), spread.alias("spread"), F.count(value).alias("n"))


def upper_median(column: str) -> Column:
    """The element at place n // 2 (from 0) of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def newest_mentions(rows: DataFrame, show: str, episode: str, at: str, mention: str, cap: int) -> DataFrame:
    """How many of a show's newest episodes mention each entity: show, mention, n."""
    episodes = rows.groupBy(show, episode).agg(F.max(at).alias("_at"))
    kept = newest(episodes, [show], [F.desc("_at"), F.desc(episode)], cap).select(show, episode)
    return rows.join(kept, [show, episode]).select(show, episode, mention).distinct().groupBy(show, mention).agg(F.count("*").alias("n"))


def sliced(rows: DataFrame, dimensions: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Each row counts in a slice of every dimension, and in ``all``: dimension, value and the sums."""
    slices = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)]
    partial = rows.groupBy(*dimensions).agg(*(F.sum(c).alias(n) for n, c in sums.items()))  # fewer rows before the fan-out
    return partial.select(F.inline(F.array(*slices)), *sums).groupBy("dimension", "value").agg(*(F.sum(n).alias(n) for n in sums))


def nearest_rank(share: float, values: str) -> Column:
    """Closest-rank percentile of a sorted array: place round(share * (n - 1)), halves to even."""
    return F.expr(f"element_at({values}, cast(rint({share} * (size({values}) - 1)) as int) + 1)")


def hit_rate(outcomes: DataFrame, keys: Sequence[str], at: str, since: Column, hit: Column, least: int, floor: float) -> DataFrame:
    """Hit rate since a time; a key is disabled if enough samples show a rate below the floor."""
    each = outcomes.where(F.col(at) > since).groupBy(*keys).agg(F.count("*").alias("samples"), F.sum(hit.cast("long")).alias("hits"))
    return each.withColumn("rate", F.col("hits") / F.col("samples")).withColumn("disabled", (F.col("samples") >= least) & (F.col("rate") < floor))
