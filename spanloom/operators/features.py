"""Scores of windows in order: baselines, neighbours, runs, and their weighted fusion.

Rows have keys, an order and value columns. Windows are by key, so a key's rows pass one task in order;
baselines by key are aggregates that are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scores import clamp, ramp
from spanloom.operators.rollups import upper_median

# The weight of each feature's score.
WEIGHTS = {"musicBed": 0.18, "lufsShift": 0.18, "dynamicRange": 0.12, "speakerShift": 0.18, "spectralShift": 0.12, "silenceBoundary": 0.10, "tempoOnset": 0.12}
# The score from which a feature passes its gate.
GATES = {"musicBed": 0.30, "lufsShift": 0.25, "dynamicRange": 0.25, "speakerShift": 0.30, "spectralShift": 0.30, "silenceBoundary": 0.5, "tempoOnset": 0.25}


def runs_where(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Rows of the flag with ``_run``, a number that neighbours of the key's order share."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_place", F.row_number().over(window))
    inside = Window.partitionBy(*keys, "_flag").orderBy("_place")
    return marked.where("_flag").withColumn("_run", F.col("_place") - F.row_number().over(inside)).drop("_flag")


def pause_clusters(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, pause: Column, least: int = 2) -> DataFrame:
    """Where runs of at least ``least`` pauses begin: keys, at, n."""
    runs = runs_where(rows, keys, order, pause).groupBy(*keys, "_run").agg(F.min(at).alias(at), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_run")


def sustained_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, value: str, gap_rows: int, least: int) -> DataFrame:
    """Runs of flagged rows that miss at most ``gap_rows`` rows in a row, of ``least`` length: keys, start, end, confidence."""
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn("_place", F.row_number().over(window)).where(flag)
    order_kept = Window.partitionBy(*keys).orderBy("_place")
    new = F.coalesce((F.col("_place") - F.lag("_place").over(order_kept) > gap_rows + 1).cast("int"), F.lit(0))
    runs = kept.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order_kept.rowsBetween(Window.unboundedPreceding, 0)))
    # the run ends where its last row does
    found = runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max(F.struct("_place", "end"))["end"].alias("end"), F.avg(value).alias("confidence"))
    return found.where(F.col("end") - F.col("start") >= least).drop("_run")


def anchored_groups(points: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """Points with ``_group``, the time of their group's first point: a group holds what lies within ``width`` of that.

    Points further apart than ``width`` never share a group, so only stretches between such gaps are folded.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    upto = order.rangeBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > width).cast("int"), F.lit(1))
    stretch = points.withColumn("_new", new).withColumn("_stretch", F.sum("_new").over(upto))
    times = stretch.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_set(at)).alias("_t"))
    starts = F.aggregate("_t", F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) > width), F.concat(acc, F.array(t))).otherwise(acc))
    # an empty array has no last element: the first time is tested by size
    anchors = times.select(*keys, "_stretch", starts.alias("_s"))
    own = F.array_max(F.filter("_s", lambda s: s <= F.col(at)))
    return stretch.join(anchors, [*keys, "_stretch"]).withColumn("_group", own).drop("_new", "_stretch", "_s")


def breaks(signals: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """Signals (at, signal: energy, spike or pause) merged into breaks: time (the mean), strength, n."""
    has = lambda s: F.max((F.col("signal") == s).cast("int"))
    grouped = anchored_groups(signals, keys, at, width).groupBy(*keys, "_group")
    return grouped.agg(F.avg(at).alias("time"), (0.4 * has("energy") + 0.3 * has("spike") + 0.3 * has("pause")).alias("strength"), F.count("*").alias("n")).drop("_group")


def silence_credit(rows: DataFrame, keys: Sequence[str], order: Sequence[str], level: str, ceiling: float = 0.02, longest: int = 4, radius: int = 2) -> DataFrame:
    """``credit`` of 1 for the rows of short silent runs and those within ``radius`` of them, else 0."""
    window = Window.partitionBy(*keys).orderBy(*order)
    new = (F.col(level) <= ceiling) & ~F.coalesce(F.lag(level).over(window) <= ceiling, F.lit(False))
    quiet = F.col(level) <= ceiling
    run = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.when(quiet, F.sum("_new").over(window)))
    length = F.count("*").over(Window.partitionBy(*keys, "_run"))
    own = run.withColumn("_own", F.when(F.col("_run").isNotNull() & (length <= longest), 1).otherwise(0))
    return own.withColumn("credit", F.max("_own").over(window.rowsBetween(-radius, radius))).drop("_new", "_run", "_own")


def feature_scores(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` (rms, flux, music, proxy, speaker) with a score of 0 to 1 by feature of WEIGHTS.

    rms against the key's upper median in decibels, flux against the averaged median, rms against the peak of four
    neighbours on either side, a speaker other than the six rows' before, onsets among three neighbours, music.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    decibel = 20 * F.log10(F.greatest(F.col("rms"), F.lit(1e-6)))
    base = rows.withColumn("_db", decibel).groupBy(*keys).agg(upper_median("_db").alias("_quiet"), F.median("flux").alias("_flux"))
    seen = silence_credit(rows, keys, order, "rms").join(base, list(keys))
    peak = F.greatest(F.max("rms").over(window.rowsBetween(-4, 4)), F.lit(1e-6))
    ratio = F.when(F.col("rms") <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("rms") / peak))
    before = F.filter(F.collect_list("speaker").over(window.rowsBetween(-6, -1)), lambda x: x.isNotNull())
    # the most frequent of six, ties to the lowest
    mode = F.element_at(F.array_sort(F.transform(F.array_distinct(before), lambda s: F.struct((-F.size(F.filter(before, lambda x: x == s))).alias("n"), s.alias("s")))), 1)["s"]
    changed = F.when((F.size(before) > 0) & F.col("speaker").isNotNull() & (mode != F.col("speaker")), 0.7).otherwise(0.0)
    onset = (F.col("rms") * F.col("flux") * F.col("music") >= 0.08).cast("double")
    density = F.avg(onset).over(window.rowsBetween(-3, 3))
    delta, flux = F.abs(decibel - F.col("_quiet")), F.when(F.col("_flux") > 0, F.col("flux") / F.col("_flux")).otherwise(0.0)
    scores = {
        "musicBed": ramp(F.col("music"), 0.15, 0.85),
        "lufsShift": ramp(delta, 1.5, 6.0),
        "dynamicRange": ramp(ratio, 0.70, 0.40),
        "speakerShift": F.greatest(ramp(F.col("proxy"), 0.30, 0.80), changed),
        "spectralShift": ramp(flux, 1.75, 3.5),
        "silenceBoundary": F.col("credit").cast("double"),
        "tempoOnset": clamp(density / 0.60, 0.0, 1.0),
    }
    return seen.withColumns(scores).drop("_quiet", "_flux", "credit")


def fuse(scored: DataFrame, floor: float = 0.01) -> DataFrame:
    """``fused``: weighted sum of the scores from ``floor`` on, at most 1; ``contributors`` in alphabetical order."""
    parts = [F.when(F.col(f) >= floor, w * F.col(f)).otherwise(0.0) for f, w in WEIGHTS.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    names = F.array_compact(F.array(*(F.when(F.col(f) >= floor, F.lit(f)) for f in sorted(WEIGHTS))))
    return scored.withColumns({"fused": clamp(total, 0.0, 1.0), "contributors": names})


def funnel(scored: DataFrame) -> DataFrame:
    """By feature how many rows have a signal and how many pass its gate: feature, produced, gated."""
    stacked = scored.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("score"), F.lit(g).alias("gate")) for f, g in GATES.items()))))
    return stacked.groupBy("feature").agg(F.count_if(F.col("score") > 0).alias("produced"), F.count_if(F.col("score") >= F.col("gate")).alias("gated"))


def music_direction(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, scale: float) -> DataFrame:
    """onset, offset and change of a probability against the row before."""
    delta = F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    return rows.withColumns({"onset": clamp(delta * scale, 0.0, 1.0), "offset": clamp(-delta * scale, 0.0, 1.0), "change": clamp(F.abs(delta) * scale, 0.0, 1.0)})


def edge_steps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """``z``: how far the mean of the rows from here on departs from that of the rows before, in the key's standard deviations."""
    window = Window.partitionBy(*keys).orderBy(*order)
    spread = rows.groupBy(*keys).agg(F.stddev_pop(value).alias("_s"))
    step = F.avg(value).over(window.rowsBetween(0, width - 1)) - F.avg(value).over(window.rowsBetween(-width, -1))
    return rows.withColumn("_d", step).join(spread, list(keys)).withColumn("z", F.when(F.col("_s") > 0, F.abs("_d") / F.col("_s"))).where("z IS NOT NULL").drop("_d", "_s")


def silence_plans(rows: DataFrame, keys: Sequence[str], kind: Column, least: int) -> DataFrame:
    """Neighbouring rows (start, end) of one kind as one plan, if long enough: keys, kind, start, end. Rows without a kind separate."""
    window = Window.partitionBy(*keys).orderBy("start", "end")
    named = rows.withColumn("kind", kind)
    new = F.coalesce((~F.col("kind").eqNullSafe(F.lag("kind").over(window))).cast("int"), F.lit(1))
    runs = named.withColumn("_new", new).withColumn("_run", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    plans = runs.where("kind IS NOT NULL").groupBy(*keys, "_run", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return plans.where(F.col("end") - F.col("start") >= least).drop("_run")


def complement(spans: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The gaps that disjoint, ordered spans leave between a key's bounds (start, end)."""
    window = Window.partitionBy(*keys).orderBy("start")
    inner = spans.select(*keys, F.col("end").alias("start"), F.lead("start").over(window).alias("end")).where("end > start")
    ends = spans.groupBy(*keys).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    outer = bounds.join(ends, list(keys), "left")
    head = outer.select(*keys, "start", F.coalesce("_lo", "end").alias("stop")).where("stop > start").withColumnRenamed("stop", "end")
    tail = outer.where("_hi IS NOT NULL").select(*keys, F.col("_hi").alias("start"), "end").where("end > start")
    return inner.unionByName(head).unionByName(tail)
