"""Slots of a stream that another version lacks: which alignments may speak, what their slots are, and which slot a span sits in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import overlap_join

ACCEPTED = "accepted"


def gate(alignments: DataFrame, least: float = 0.5) -> DataFrame:
    """Alignments (stored_version, version, stored_identity, identity, fraction) with ``outcome``: the first reason against one, or accepted. What is null counts against it."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    outcome = F.when(no(F.col("stored_version") == F.col("version")), "staleVersion").when(no(F.col("stored_identity") == F.col("identity")), "audioIdentityMismatch").when(no(F.col("fraction") >= least), "lowAlignedFraction")
    return alignments.withColumn("outcome", outcome.otherwise(ACCEPTED))


def merged(slots: DataFrame, keys: Sequence[str], gap: float = 3.0, longest: float = 480.0) -> DataFrame:
    """Slots (start, end, left, right) of all versions of a key, fragments at most ``gap`` apart as one; those over ``longest`` are left out.

    ``left`` is the first fragment's flank and ``right`` that of the last, in order of start and end; of fragments at one place the shorter flank counts.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = slots.withColumn("_new", F.when(F.col("start") - reach <= gap, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "end", "left"))["left"].alias("left"), F.max(F.struct("start", "end", (-F.col("right")).alias("r")))["r"].alias("right"))
    return whole.drop("_g").withColumn("right", -F.col("right")).where(F.col("end") - F.col("start") <= longest)


def flank_confidence(seconds: Column, full: float = 60.0) -> Column:
    """How far a slot's edge is to be believed, by the seconds of what is common beside it."""
    return 1 - F.exp(-seconds / full)


def _proper(spans: DataFrame) -> DataFrame:
    """Those that end behind their start: what has no length meets nothing."""
    return spans.where(F.col("end") > F.col("start"))


def _enclosing(chosen: DataFrame, vetoes: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """keys, id of chosen slots (start, end, core_start, core_end) that take in a vetoed stretch which the span itself does not touch."""
    met = overlap_join(chosen, _proper(vetoes).select(*keys, "start", "end"), keys, bucket)
    outside = ~((F.col("a.core_start") < F.col("b.end")) & (F.col("b.start") < F.col("a.core_end")))
    return met.where(outside).select(*keys, F.col("a.id").alias("id")).distinct().withColumn("_veto", F.lit(True))


def owned(spans: DataFrame, slots: DataFrame, vetoes: DataFrame, keys: Sequence[str], bucket: int, least: float = 0.8) -> DataFrame:
    """Spans (id, start, end) with the slot that overlaps each most (then the first, then the shorter): slot_start, slot_end, coverage, confidence, reason.

    A slot that covers less than ``least`` of the span counts only if it lies within it and no other slot meets it. ``reason``
    tells why a span has no slot; its slot is then the best there was.
    """
    met = overlap_join(_proper(spans), _proper(slots), keys, bucket)
    length = F.col("a.end") - F.col("a.start")
    shared = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    best = met.groupBy(*keys, F.col("a.id").alias("id")).agg(F.count("*").alias("_n"), F.min(F.struct((-shared).alias("s"), F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.left").alias("left"), F.col("b.right").alias("right"), length.alias("length"))).alias("_b"))
    rows = spans.select(*keys, "id", F.col("start").alias("core_start"), F.col("end").alias("core_end")).join(best, [*keys, "id"], "left")
    found = rows.select(*keys, "id", "core_start", "core_end", "_n", F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), (-F.col("_b.s") / F.col("_b.length")).alias("coverage"), F.least(flank_confidence(F.col("_b.left")), flank_confidence(F.col("_b.right"))).alias("confidence"))
    inside = (F.col("start") >= F.col("core_start")) & (F.col("end") <= F.col("core_end")) & (F.col("_n") == 1)
    vetoed = found.join(_enclosing(found.where("start IS NOT NULL"), vetoes, keys, bucket), [*keys, "id"], "left")
    reason = F.when(~F.coalesce(F.col("core_end") > F.col("core_start"), F.lit(False)), "degenerateCore").when(F.col("start").isNull(), "noCandidatePairs").when((F.col("coverage") < least) & ~inside, "coreCoverageBelowMinimum").when(F.col("_veto"), "vetoNewlyEnclosed")
    return vetoed.select(*keys, "id", F.col("start").alias("slot_start"), F.col("end").alias("slot_end"), "coverage", "confidence", reason.alias("reason"))


def resolved(spans: DataFrame, breaks: DataFrame, vetoes: DataFrame, keys: Sequence[str], bucket: int, radius: float = 120.0, inward: float = 8.0, shortest: float = 5.0, longest: float = 180.0, edge_floor: float = 0.15, confidence_floor: float = 0.15, least: float = 0.8, penalty: float = 1.5) -> DataFrame:
    """Spans (id, start, end) with the slot between two breaks (at, score) near their ends: slot_start, slot_end, coverage, confidence, reason.

    Pairs of breaks are ranked by what they add to the span, then by their weaker score; a later pair takes over if it is ``penalty`` times as
    sure as the one in front. Breaks within ``radius`` outside and ``inward`` inside of an end are candidates, so what is paired is bounded by
    these two stretches. Of breaks at one time the best score counts.
    """
    once = breaks.where("at IS NOT NULL").groupBy(*keys, "at").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    points = once.select(*keys, (F.col("at") - 1e-6).alias("start"), (F.col("at") + 1e-6).alias("end"), "at", "score")
    proper = spans.where(F.col("end") > F.col("start")).select(*keys, "id", F.col("start").alias("core_start"), F.col("end").alias("core_end"))

    def near(low: Column, high: Column, name: str) -> DataFrame:
        """Of each span the breaks of one side, as an array: they lie within some minutes."""
        around = proper.select(*keys, "id", low.alias("start"), high.alias("end"))
        found = overlap_join(around, points, keys, bucket).where((F.col("b.at") >= F.col("a.start")) & (F.col("b.at") <= F.col("a.end")))
        return found.groupBy(*keys, F.col("a.id").alias("id")).agg(F.collect_list(F.struct("b.at", "b.score")).alias(name))

    starts = near(F.col("core_start") - radius, F.col("core_start") + inward, "starts")
    ends = near(F.col("core_end") - inward, F.col("core_end") + radius, "ends")
    both = proper.join(starts, [*keys, "id"], "left").join(ends, [*keys, "id"], "left")
    none = F.array().cast("array<struct<at:double,score:double>>")
    s, e = F.col("core_start"), F.col("core_end")

    def pair(x: Column, y: Column) -> Column:
        shared = F.least(y["at"], e) - F.greatest(x["at"], s)
        weaker = F.least(x["score"], y["score"])
        return F.struct((y["at"] - x["at"] - shared).alias("extra"), (-weaker).alias("order"), x["at"].alias("start"), y["at"].alias("end"), weaker.alias("confidence"), (shared / (e - s)).alias("coverage"), shared.alias("shared"))

    every = F.flatten(F.transform(F.coalesce("starts", none), lambda x: F.transform(F.coalesce("ends", none), lambda y: pair(x, y))))
    valid = both.withColumn("_p", F.filter(every, lambda p: (p["start"] < p["end"]) & (p["shared"] > 0)))
    fits = lambda p: (p["end"] - p["start"]).between(shortest, longest)
    ranked = valid.withColumn("_r", F.array_sort(F.filter("_p", fits)))
    champion = F.aggregate(F.col("_r"), F.get("_r", F.lit(0)), lambda best, p: F.when(p["confidence"] >= penalty * best["confidence"], p).otherwise(best))
    chosen = ranked.withColumn("_c", champion).select(*keys, "id", "core_start", "core_end", F.col("_c.start").alias("start"), F.col("_c.end").alias("end"), F.col("_c.coverage").alias("coverage"), F.col("_c.confidence").alias("confidence"), (F.size("_p") > 0).alias("_some"))
    judged = chosen.join(_enclosing(chosen.where("start IS NOT NULL"), vetoes, keys, bucket), [*keys, "id"], "left")
    reason = (
        F.when(F.col("start").isNull(), F.when(F.col("_some"), "durationOutOfRange").otherwise("noCandidatePairs"))
        .when(F.col("confidence") < edge_floor, "edgeBelowFloor").when(F.col("confidence") < confidence_floor, "slotConfidenceBelowFloor")
        .when(F.col("coverage") < least, "coreCoverageBelowMinimum").when(F.col("_veto"), "vetoNewlyEnclosed")
    )
    found = judged.select(*keys, "id", F.col("start").alias("slot_start"), F.col("end").alias("slot_end"), "coverage", "confidence", reason.alias("reason"))
    empty = spans.where(~F.coalesce(F.col("end") > F.col("start"), F.lit(False))).select(*keys, "id")
    return found.unionByName(empty.withColumn("reason", F.lit("degenerateCore")), allowMissingColumns=True)
