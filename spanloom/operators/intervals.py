"""Interval algebra over rows of keys, a start and an end (exclusive), in any ordered number.

Rows with a null end or start, or that end before they start, take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Spans of more buckets than this are joined by their keys alone.
LONGEST = 64


def valid(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") <= F.col("end")))


def _islands(spans: DataFrame, keys: Sequence[str], gap: int, sums: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + F.lit(gap)), 1).otherwise(0))
    grouped = marked.withColumn("_island", F.sum("_new").over(upto)).groupBy(*keys, "_island")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), *(F.sum(s).alias(s) for s in sums)).drop("_island")


def merge(spans: DataFrame, keys: Sequence[str], gap: int = 0, sums: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """Islands of spans that overlap, touch or lie within ``gap``: keys, start, end and the summed columns.

    With ``bucket``, spans are first merged by key and stretch of that length, so that a key with very many
    rows is worked off by many tasks; merging what is merged changes nothing.
    """
    some = valid(spans).select(*keys, "start", "end", *sums)
    if bucket:
        stretch = some.withColumn("_stretch", F.floor(F.col("start") / bucket))
        some = _islands(stretch, [*keys, "_stretch"], gap, sums).drop("_stretch")
    return _islands(some, keys, gap, sums)


def union_length(spans: DataFrame, keys: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Covered length for each key."""
    return merge(spans, keys, bucket=bucket).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def sweep(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elementary stretches between all ends of two sets, with how many spans of each cover them (in_a, in_b)."""

    def ends(spans: DataFrame, side: str) -> DataFrame:
        other = "db" if side == "da" else "da"
        points = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias(side)), F.struct(F.col("end").alias("at"), F.lit(-1).alias(side)))
        return valid(spans).select(*keys, F.inline(points)).withColumn(other, F.lit(0)).select(*keys, "at", "da", "db")

    points = ends(a, "da").unionByName(ends(b, "db")).groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("da").over(upto).alias("in_a"), F.sum("db").over(upto).alias("in_b")).where("end IS NOT NULL")


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What A covers and B does not, merged."""
    return merge(sweep(a, b, keys).where("in_a > 0 AND in_b = 0"), keys)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What both cover, merged."""
    return merge(sweep(a, b, keys).where("in_a > 0 AND in_b > 0"), keys)


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Pairs with ``a.start < b.end`` and ``b.start < a.end``, as structs a and b.

    A range join as an equi-join: spans go to every bucket that they meet, and a pair counts in the
    bucket where the later of the two starts. Buckets also spread the rows of a frequent key. A span of
    more than ``LONGEST`` buckets, an open end included, is not dealt out.
    """

    long = lambda e, s: e - s > bucket * LONGEST

    def dealt(spans: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))
        some = valid(spans).where(~long(F.col("end"), F.col("start")))
        return some.select(*keys, F.explode(cells).alias("_cell"), F.struct(*spans.columns).alias(name))

    whole = lambda spans, name: valid(spans).select(*keys, long(F.col("end"), F.col("start")).alias("_long"), F.struct(*spans.columns).alias(name))
    meets = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    both = dealt(a, "a").join(dealt(b, "b"), [*keys, "_cell"])
    both = both.where(meets & (F.floor(F.greatest("a.start", "b.start") / bucket) == F.col("_cell"))).drop("_cell")
    # the few spans of very many buckets are joined by their keys alone
    a_long, b_long = whole(a, "a").where("_long").drop("_long"), whole(b, "b").where("_long").drop("_long")
    b_short = whole(b, "b").where("NOT _long").drop("_long")
    return both.unionByName(a_long.join(b_short.unionByName(b_long), keys).where(meets)).unionByName(whole(a, "a").where("NOT _long").drop("_long").join(b_long, keys).where(meets))


def overlap_length(a: str = "a", b: str = "b") -> Column:
    return F.least(f"{a}.end", f"{b}.end") - F.greatest(f"{a}.start", f"{b}.start")


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of two overlapping structs; 1 for two equal spans without length."""
    whole = F.greatest(f"{a}.end", f"{b}.end") - F.least(f"{a}.start", f"{b}.start")
    return F.when(whole == 0, 1.0).otherwise(F.greatest(overlap_length(a, b), F.lit(0)) / whole)


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], within: int) -> DataFrame:
    """Each left row (keys, at, ...) with the first right ``at`` at or after it, null beyond ``within``.

    One shuffle: both sides are sorted together and the next right time is read by a window.
    """
    both = left.withColumn("_right", F.lit(None).cast("long")).unionByName(right.select(*keys, F.col("at"), F.col("at").alias("_right")), allowMissingColumns=True).withColumn("_side", F.when(F.col("_right").isNull(), 0).otherwise(1))
    ahead = Window.partitionBy(*keys).orderBy("at", "_side").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next_at", F.first("_right", ignorenulls=True).over(ahead)).where("_side = 0")
    return found.withColumn("next_at", F.when(F.col("next_at") - F.col("at") <= within, F.col("next_at"))).drop("_right", "_side")


def consecutive_runs(rows: DataFrame, keys: Sequence[str], ordinal: str, anchored: Column) -> DataFrame:
    """Maximal runs of consecutive ordinals that are anchored: keys, first, last, n."""
    order = Window.partitionBy(*keys).orderBy(ordinal)
    kept = rows.where(anchored).select(*keys, ordinal).distinct()
    return kept.withColumn("_run", F.col(ordinal) - F.row_number().over(order)).groupBy(*keys, "_run").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count("*").alias("n")).drop("_run")
