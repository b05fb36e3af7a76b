"""Scores over ordered rows and groups: hit groups, neighbours, breaks, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import merge, overlap_join


def hit_groups(hits: DataFrame, keys: Sequence[str], gap: int, least: float = 0.95, cap: float = 0.95) -> DataFrame:
    """Groups of promoting hits (start, end, weight) no more than ``gap`` apart, with a score that saturates.

    A group needs two hits, or one of weight ``least``. Hits of negative weight promote nothing: those within ``gap``
    of a group only lower its weight. Hits of which the optional column ``metadata`` is true count in a group that has others, and
    never make one strong. Weights are summed as hundredths.
    """
    meta = F.coalesce(F.col("metadata"), F.lit(False)) if "metadata" in hits.columns else F.lit(False)
    rows = hits.select(*keys, "start", "end", F.round(F.col("weight") * 100).cast("long").alias("weight"), meta.alias("_meta"))
    own = (~F.col("_meta")).cast("long")
    marked = rows.where("weight >= 0").select(*keys, "start", "end", F.lit(1).cast("long").alias("n_hits"), "weight", (own * (F.col("weight") >= round(least * 100)).cast("long")).alias("n_strong"), own.alias("n_own"))
    groups = merge(marked, keys, gap=gap, sums=["n_hits", "weight", "n_strong", "n_own"])
    negative = rows.where("weight < 0").select(*keys, (F.col("start") - gap).alias("start"), (F.col("end") + gap).alias("end"), F.col("weight").alias("less"))
    closed = groups.withColumn("end", F.col("end") + 1)  # ends are closed here
    near = overlap_join(negative.withColumn("end", F.col("end") + 1), closed, keys, bucket=max(1, 4 * gap))
    less = near.groupBy(*keys, F.col("b.start").alias("start")).agg(F.sum("a.less").alias("less"))
    scored = groups.join(less, [*keys, "start"], "left").withColumn("weight", F.col("weight") + F.coalesce("less", F.lit(0)))
    total = F.greatest(F.col("weight"), F.lit(0)) / 100.0
    score = F.least(F.lit(cap), 1 - 1 / (1 + F.lit(0.3) * total))
    return scored.where("n_own >= 1 AND (n_hits >= 2 OR n_strong >= 1)").select(*keys, "start", "end", "n_hits", F.round(score, 6).alias("score"))


def regularize(spans: DataFrame, keys: Sequence[str], near: int, short: int, strong: float = 0.8) -> DataFrame:
    """Confidence times .85 without a strong neighbour within ``near``, and times .9 if then also short; a key's only row stays.

    The nearest strong span on either side decides, which running extremes over the key's rows give.
    """
    everything = Window.partitionBy(*keys)
    order = everything.orderBy("start", "end", "id")
    is_strong = F.col("confidence") >= strong
    reach = F.max(F.when(is_strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(is_strong, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = spans.withColumn("_n", F.count("*").over(everything)).withColumn("_reach", reach).withColumn("_ahead", ahead)
    backed = F.coalesce(F.col("start") - F.col("_reach") <= near, F.lit(False)) | F.coalesce(F.col("_ahead") - F.col("end") <= near, F.lit(False))
    factor = F.when((F.col("_n") == 1) | backed, 1.0).when(F.col("end") - F.col("start") < short, 0.85 * 0.9).otherwise(0.85)
    return seen.withColumn("confidence", F.round(F.col("confidence") * factor, 6)).drop("_n", "_reach", "_ahead")


def local_maxima(rows: DataFrame, keys: Sequence[str], at: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is at least that of both neighbours."""
    order = Window.partitionBy(*keys).orderBy(*at)
    low = F.lit(float("-inf"))
    around = rows.withColumn("_l", F.lag(value).over(order)).withColumn("_r", F.lead(value).over(order))
    return around.where((F.col(value) >= F.coalesce("_l", low)) & (F.col(value) >= F.coalesce("_r", low))).drop("_l", "_r")


def transitions(rows: DataFrame, keys: Sequence[str], at: Sequence[str], value: str, loud: float, step: float, share: float) -> DataFrame:
    """Neighbours whose level changes: kind ``rise`` or ``drop`` at the later row."""
    order = Window.partitionBy(*keys).orderBy(*at)
    pair = rows.withColumn("before", F.lag(value).over(order)).where("before IS NOT NULL")
    top, diff = F.greatest(value, "before"), F.abs(F.col(value) - F.col("before"))
    kind = F.when(F.col(value) > F.col("before"), "rise").otherwise("drop")
    return pair.where((top >= loud) & (diff >= step) & (diff / top > share)).withColumn("kind", kind)


def spikes(rows: DataFrame, keys: Sequence[str], value: str, share: float = 0.8, factor: float = 2.0) -> DataFrame:
    """Rows above ``factor`` times the interpolated percentile of their key."""
    high = rows.groupBy(*keys).agg(F.expr(f"percentile({value}, {share})").alias("p"))
    return rows.join(high, list(keys)).where(F.col(value) > factor * F.col("p"))


def smooth(rows: DataFrame, keys: Sequence[str], at: Sequence[str], value: str) -> DataFrame:
    """Moving average of weights 1, 2, 1, renormalised at the edges, as ``smoothed``."""
    order = Window.partitionBy(*keys).orderBy(*at)
    left, right = F.lag(value).over(order), F.lead(value).over(order)
    total = F.coalesce(left, F.lit(0.0)) + 2 * F.col(value) + F.coalesce(right, F.lit(0.0))
    weight = 2 + left.isNotNull().cast("int") + right.isNotNull().cast("int")
    return rows.withColumn("smoothed", F.round(total / weight, 6))


def pi_control(signals: DataFrame, keys: Sequence[str], at: Sequence[str], error: str, base: float = 0.7, least: int = 5) -> DataFrame:
    """Proportional-integral offset of a threshold after each signal: a running sum and the last error decide."""
    upto = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    n, total = F.count("*").over(upto), F.sum(error).over(upto)
    offset = F.when(n < least, 0.0).otherwise(F.greatest(F.lit(-0.15), F.least(F.lit(0.15), 0.02 * F.col(error) + 0.005 * total)))
    return signals.withColumn("offset", F.round(offset, 6)).withColumn("threshold", F.round(F.greatest(F.lit(0.55), F.least(F.lit(0.95), base + F.col("offset"))), 6))


def bands(score: Column) -> Column:
    """Confidence bands at .40, .60, .70 and .80."""
    return F.when(score >= 0.8, "autoSkip").when(score >= 0.7, "confirm").when(score >= 0.6, "mark").when(score >= 0.4, "candidate").otherwise("none")


def match_greedy(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one matches of (p, t, iou): each prediction claims its best truth, each truth keeps its best claim."""
    claim = Window.partitionBy(*keys, "p").orderBy(F.desc("iou"), "t")
    keep = Window.partitionBy(*keys, "t").orderBy(F.desc("iou"), "p")
    claims = pairs.withColumn("_c", F.row_number().over(claim)).where("_c = 1")
    return claims.withColumn("_k", F.row_number().over(keep)).where("_k = 1").drop("_c", "_k")


def pr_curve_area(samples: DataFrame, score: str, positive: Column, bins: int = 4096) -> DataFrame:
    """Area under precision and recall by trapezoids, tied scores as one step, from (0, 1).

    Scores are summed up in ``bins`` ranges between the least and the largest; the ordered window over all of them
    sees one row a range, and each range's own steps are then summed behind what lies above it.
    """
    steps = samples.groupBy(score).agg(F.sum(positive.cast("long")).alias("tp"), F.count("*").alias("n"))
    ends = steps.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum("tp").alias("all"))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    placed = steps.join(F.broadcast(ends)).withColumn("bin", place)
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # ``bins`` rows at most; the last step of a range is the point before the next range's first
    ranges = placed.groupBy("bin").agg(F.sum("tp").alias("t"), F.sum("n").alias("m")).select("bin", zero(F.sum("t").over(above)).alias("t0"), zero(F.sum("m").over(above)).alias("m0"))
    order = Window.partitionBy("bin").orderBy(F.desc(score))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(F.broadcast(ranges), "bin").withColumns({"ctp": F.col("t0") + F.sum("tp").over(upto), "cn": F.col("m0") + F.sum("n").over(upto)})
    was_tp, was_n = F.col("ctp") - F.col("tp"), F.col("cn") - F.col("n")
    before = F.when(was_n > 0, was_tp / was_n).otherwise(1.0)
    area = (F.col("tp") / F.col("all")) * (F.col("ctp") / F.col("cn") + before) / 2
    return run.agg(F.round(F.sum(area), 6).alias("auc_pr"))
