"""Keyed stores: upserts, lifecycles, decaying trust, folds of ordered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("candidate", "quarantined", "active", "decayed", "blocked")


def upsert(store: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both of (keys, n, confidence, last_seen) as one store: counts add up, the rest is the larger."""
    return store.unionByName(rows).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"))


def _promoted(state: str, confirmed: Column, rolled: Column) -> Column:
    """The state after one step, as its place in STATES."""
    place = lambda s: F.lit(STATES.index(s))
    rate = F.when(confirmed + rolled > 0, rolled / (confirmed + rolled)).otherwise(0.0)
    good = (confirmed >= 2) & (rate <= 0.3)
    return {
        "candidate": F.when(confirmed >= 1, place("quarantined")).otherwise(place("candidate")),
        "quarantined": F.when(good, place("active")).otherwise(place("quarantined")),
        "active": F.when(rate > 0.5, place("decayed")).otherwise(place("active")),
        "decayed": F.when(good, place("active")).otherwise(place("decayed")),
        "blocked": place("blocked"),
    }[state]


def _after(step: Column, acc: Column) -> Column:
    return F.transform(acc, lambda s: F.get(step, s))


def lifecycle(events: DataFrame, keys: Sequence[str], order: Sequence[str], confirmed: Column, rolled: Column, chunk: int = 1024, steps: int = 5) -> DataFrame:
    """Each key's state after its events in order: keys, confirmed, rolled, state.

    An event maps every state to the next one, up to ``steps`` steps. Maps are composed in chunks of a key's events,
    then the chunks' maps: composition is associative, so no key is gathered as a whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    counted = events.select(*keys, F.row_number().over(window).alias("_i"), F.sum(confirmed.cast("long")).over(upto).alias("confirmed"), F.sum(rolled.cast("long")).over(upto).alias("rolled"))
    once = F.array(*(_promoted(s, F.col("confirmed"), F.col("rolled")) for s in STATES))
    stable = once
    for _ in range(steps - 1):
        stable = _after(once, stable)
    start = F.array(*(F.lit(i) for i in range(len(STATES))))
    compose = lambda maps: F.aggregate(maps, start, lambda acc, m: _after(m["f"], acc))
    maps = counted.select(*keys, "_i", "confirmed", "rolled", stable.alias("f"))
    chunks = maps.groupBy(*keys, F.floor(F.col("_i") / chunk).alias("_c")).agg(compose(F.array_sort(F.collect_list(F.struct("_i", "f")))).alias("f"), F.max("confirmed").alias("confirmed"), F.max("rolled").alias("rolled"))
    whole = chunks.groupBy(*keys).agg(compose(F.array_sort(F.collect_list(F.struct("_c", "f")))).alias("f"), F.max("confirmed").alias("confirmed"), F.max("rolled").alias("rolled"))
    return whole.select(*keys, "confirmed", "rolled", F.get(F.array(*map(F.lit, STATES)), F.get("f", F.lit(0))).alias("state"))


def listening_time(events: DataFrame, keys: Sequence[str], at: str, playing: Column, longest: int) -> DataFrame:
    """Whole units of time in which a key plays: from a start to the key's next event, each stretch cut at ``longest``."""
    window = Window.partitionBy(*keys).orderBy(at, "event_id")
    gap = F.least(F.lead(at).over(window) - F.col(at), F.lit(longest))
    return events.withColumn("_g", F.when(playing & (gap > 0), gap)).groupBy(*keys).agg(F.coalesce(F.sum("_g"), F.lit(0)).alias("listened"))


def moving_average(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, alpha: float = 0.3, reach: int = 128) -> DataFrame:
    """Exponential moving average after a key's last row; the first row seeds it.

    Only the newest ``reach`` rows of a key are summed: older ones weigh less than (1 - alpha) ** reach in all.
    ``order`` is newest first.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(*keys))
    near = rows.withColumns({"_i": F.row_number().over(window) - 1, "_n": n}).where(F.col("_i") < reach)
    weight = F.pow(F.lit(1 - alpha), F.col("_i")) * F.when(F.col("_i") == F.col("_n") - 1, 1.0).otherwise(alpha)
    return near.groupBy(*keys).agg(F.sum(weight * F.col(value)).alias("average"), F.max("_n").alias("n"))


def demotion(events: DataFrame, keys: Sequence[str], delta: Column, floor: Column) -> DataFrame:
    """Each key's multiplier: 1 less a step for each event, never below the floor."""
    each = events.groupBy(*keys).agg(F.count("*").alias("n"), F.max(delta).alias("_d"), F.max(floor).alias("_f"))
    return each.select(*keys, "n", F.greatest("_f", 1 - F.col("n") * F.col("_d")).alias("multiplier"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last row: a running maximum."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *rest)).alias("_l"))
    return last.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in rest))


def orphans(runs: DataFrame, now: Column, timeout: int) -> DataFrame:
    """Runs that have begun, not ended and been silent for longer than the timeout."""
    return runs.where(F.col("ended").isNull() & (now - F.col("beat") > timeout))


def broad_promotion(corrections: DataFrame, keys: Sequence[str], at: str, now: Column, horizon: int, count: float, episodes: int, days: int) -> DataFrame:
    """Keys whose corrections within the horizon reach a weighted count, distinct episodes and distinct days."""
    active = corrections.where(F.col(at) >= now - horizon)
    each = active.groupBy(*keys).agg(F.sum("weight").alias("weighted"), F.countDistinct("episode").alias("episodes"), F.countDistinct("day").alias("days"))
    return each.where((F.col("weighted") >= count - 1e-9) & (F.col("episodes") >= episodes) & (F.col("days") >= days))


def findings(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks: key, rule. Nothing is repaired."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def network_blend(base: Column, other: Column, weight: Column) -> Column:
    return base * (1 - weight) + other * weight


def trait_weight(n: Column) -> Column:
    return F.when(n >= 3, 0.4 + 0.2 * (F.least(F.greatest(n, F.lit(3)), F.lit(7)) - 3) / 4).otherwise(0.0)


def local_weight(n: Column) -> Column:
    return F.when(n >= 5, 0.6 + 0.2 * (F.least(F.greatest(n, F.lit(5)), F.lit(10)) - 5) / 5).otherwise(0.0)
