"""Profiles that follow a key's events: trust modes, device estimates, jingles, capabilities, and verdicts that must persist.

A machine takes one event at a time and gives the profile after it. The batch form folds sorted rows; ``streaming.profiles`` feeds
the same classes from a stream. What running counts can tell is left to Spark. Events with a null key, time or order take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.segments import _fold

MODES = ("shadow", "manual", "auto")


@dataclass
class TrustMode:
    """Hundredths of trust in a show, and the mode that it has earned. Events: good (with a confidence), false, decay, override (with a mode).

    The first good observation makes the profile, at once in manual mode if it is exceptional. A show goes from shadow to
    manual by observations and trust; auto is reached by override alone. Two false signals end auto, four end manual. False signals
    and decay of a show without a profile do nothing, and so does an unknown event.
    """

    exceptional: float = 0.92
    step: int = 10
    observations_for_manual: int = 3
    trust_for_manual: int = 40
    ends_auto: int = 2
    ends_manual: int = 4
    mode: str | None = None
    trust: int = 0
    observations: int = 0
    false_signals: int = 0
    false_positives: int = 0

    COLUMNS = ("event", "confidence", "mode")
    SCHEMA = "mode string, trust int, observations int, false_signals int, false_positives int"

    def take(self, event: str | None, confidence: float | None, mode: str | None) -> tuple:
        if event == "good" and confidence is not None:
            self._good(confidence)
        elif event == "override" and mode in MODES:
            if self.mode is None:
                self.trust = 50
            self.mode = mode
        elif event == "false" and self.mode is not None:
            self.false_signals += 1
            self.false_positives += 1
            self.trust = max(0, self.trust - self.step)
            if self.mode == "auto" and self.false_signals >= self.ends_auto:
                self.mode = "manual"
            elif self.mode == "manual" and self.false_signals >= self.ends_manual:
                self.mode = "shadow"
        elif event == "decay":
            self.false_signals //= 2
        return self.mode, self.trust, self.observations, self.false_signals, self.false_positives

    def _good(self, confidence: float) -> None:
        self.observations += 1
        if self.mode is None:
            self.mode, self.trust = ("manual", 50) if confidence >= self.exceptional else ("shadow", 20)
            return
        self.trust = min(100, self.trust + self.step)
        if self.mode == "shadow" and self.observations >= self.observations_for_manual and self.trust >= self.trust_for_manual:
            self.mode = "manual"


@dataclass
class DeviceProfile:
    """A device class's grants against what was expected (``seed`` seconds): mean and spread, a moving average, and a factor that follows it in notches.

    The factor moves from the ``active`` th observation on, a notch a day at most, within the band. So many observations in a row whose average is outside
    the band make the profile start anew. An observation that is not positive and finite changes nothing.
    """

    alpha: float = 0.2
    active: int = 30
    low: float = 0.5
    high: float = 2.0
    notch: float = 0.1
    pause: int = 86_400
    divergent: int = 10
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    average: float = 0.0
    factor: float = 1.0
    outside: int = 0
    moved_at: float | None = None

    COLUMNS = ("seconds", "at", "seed")
    SCHEMA = "n int, mean double, m2 double, average double, factor double, outside int, happened string"

    def take(self, seconds: float | None, at: float, seed: float | None) -> tuple:
        happened = self._apply(seconds, at, seed or 0.0) if seconds is not None and 0 < seconds < float("inf") else "ignored"
        return self.n, self.mean, self.m2, self.average, self.factor, self.outside, happened

    def _apply(self, seconds: float, at: float, seed: float) -> str:
        self.n += 1
        delta = seconds - self.mean
        self.mean += delta / self.n
        self.m2 += delta * (seconds - self.mean)
        self.average = seconds if self.n == 1 else self.alpha * seconds + (1 - self.alpha) * self.average
        wanted = self.average / seed if seed > 0 else 1.0
        self.outside = self.outside + 1 if wanted > self.high or wanted < self.low else 0
        if self.n < self.active:
            return "learning"
        if self.outside >= self.divergent:
            self.n, self.mean, self.m2, self.average, self.factor, self.outside, self.moved_at = 0, 0.0, 0.0, 0.0, 1.0, 0, None
            return "reverted"
        if self.moved_at is not None and at - self.moved_at < self.pause:
            return "waiting"
        wanted = min(self.high, max(self.low, wanted))
        gap = wanted - self.factor
        to = wanted if abs(gap) <= self.notch else self.factor + (self.notch if gap > 0 else -self.notch)
        to = min(self.high, max(self.low, to))
        if abs(to - self.factor) <= 2.220446049250313e-16:
            return "settled"
        self.factor, self.moved_at = to, at
        return "moved"


@dataclass
class Jingles:
    """Fingerprints (64 bits) of a show's openings and ends, and whether episodes go on having them. An episode confirms if one of its two is near a known
    one; ``evict`` misses in a row forget everything. Null and 0 are no fingerprints; the oldest ones beyond ``most`` are forgotten."""

    near: int = 8
    confirm: int = 3
    evict: int = 30
    most: int = 16
    hashes: list = field(default_factory=list)
    confirmations: int = 0
    misses: int = 0

    COLUMNS = ("start_hash", "end_hash")
    SCHEMA = "known int, confirmations int, misses int, matched boolean, confirmed boolean"

    def take(self, start_hash: int | None, end_hash: int | None) -> tuple:
        def close(a: int, b: int) -> bool:
            return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= self.near

        found = [h for h in (start_hash, end_hash) if h]
        matched = any(close(h, k) for h in found for k in self.hashes)
        for h in found:
            if not any(close(h, k) for k in self.hashes):
                self.hashes.append(h)
        del self.hashes[: max(0, len(self.hashes) - self.most)]
        self.confirmations, self.misses = (self.confirmations + 1, 0) if matched else (self.confirmations, self.misses + 1)
        if self.misses >= self.evict:
            self.hashes, self.confirmations, self.misses, matched = [], 0, 0, False
        return len(self.hashes), self.confirmations, self.misses, matched, self.confirmations >= self.confirm


def histories(events: DataFrame, keys: Sequence[str], key_types: str, order: Sequence[str], order_types: str, machine: type, **config: float) -> DataFrame:
    """The profile after each event: keys, order, the machine's columns. A task holds one key's events at a time, which Spark has sorted."""
    there = events.dropna(subset=[*keys, *order])

    def run(rows: list[tuple]) -> Iterator[tuple]:
        m = machine(**config)
        for row in rows:
            yield (*row[: len(order)], *m.take(*row[len(order) :]))

    columns = [*order, *machine.COLUMNS]
    renamed = there.select(*keys, *order, *(F.col(c).alias(f"_{c}") for c in machine.COLUMNS))
    return _fold(renamed, keys, order, [*order, *(f"_{c}" for c in columns[len(order) :])], run, f"{key_types}, {order_types}, {machine.SCHEMA}")


KINDS = (("chapters", 0.8, "chapterRich"), ("host", 0.7, "hostReadOnly"), ("sponsor", 0.5, "sponsorDeclared"), ("dynamic", 0.5, "dynamicInsertionHeavy"))


def capability(episodes: DataFrame, keys: Sequence[str], reliable_bed: Column, admitted: Column, least: int = 5) -> DataFrame:
    """Each key's kind by the share of its episodes (boolean columns chapters, host, sponsor, dynamic) that have a trait, the first of these to be frequent enough.

    ``reliable_bed`` and ``admitted`` are aggregates of a key. Unknown with fewer than ``least`` episodes or where not admitted; null traits are not there. Counts add up, so no order is needed.
    """
    counts = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c, _, _ in KINDS]
    each = episodes.groupBy(*keys).agg(F.count("*").alias("n"), *counts, F.coalesce(reliable_bed, F.lit(False)).alias("_bed"), F.coalesce(admitted, F.lit(False)).alias("_in"))
    kind = F.when((F.col("n") < least) | ~F.col("_in"), "unknown").when(F.col("_bed"), "musicBedReliable")
    for name, share, value in KINDS:
        kind = kind.when(F.col(name) / F.col("n") >= share, value)
    return each.select(*keys, "n", *(c for c, _, _ in KINDS), kind.otherwise("unknown").alias("kind"))


#: What a pass is blocked by, the gravest first.
BLOCKERS = ("analysisUnavailable", "storageFull", "waitingForNetwork")


def blockers(children: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Passes of batches from their children (ready, reason, fixable): keys, at, candidate.

    tripReady if all are ready, else the gravest reason of a child that the user can mend; null if there is none.
    """
    each = children.groupBy(*keys, at).agg(F.bool_and(F.coalesce("ready", F.lit(False))).alias("all"), *(F.bool_or(F.coalesce((F.col("reason") == b) & F.col("fixable"), F.lit(False))).alias(b) for b in BLOCKERS))
    candidate = F.when(F.col("all"), "tripReady")
    for b in BLOCKERS:
        candidate = candidate.when(F.col(b), b)
    return each.select(*keys, at, candidate.alias("candidate"))


def persistent(passes: DataFrame, keys: Sequence[str], at: str, least_passes: int = 2, least_seconds: int = 1800) -> DataFrame:
    """Passes with ``verdict``: tripReady at once, a blocker only from the second blocked pass in a row on, half an hour after the first (of any blocker); null else.

    ``at`` is in seconds. A streak is told by running counts.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    blocked = F.col("candidate").isNotNull() & (F.col("candidate") != "tripReady")
    streak = passes.withColumns({"_b": F.coalesce(blocked, F.lit(False)), "_s": F.sum(F.when(F.coalesce(blocked, F.lit(False)), 0).otherwise(1)).over(order)})
    within = Window.partitionBy(*keys, "_s", "_b").orderBy(at)
    counted = streak.withColumns({"_n": F.row_number().over(within), "_first": F.first(at).over(within)})
    ripe = (F.col("_n") >= least_passes) & (F.col(at) - F.col("_first") >= least_seconds)
    return counted.withColumn("verdict", F.when(~F.col("_b"), F.col("candidate")).when(ripe, F.col("candidate"))).drop("_b", "_s", "_n", "_first")
