"""Predictions against truth: matching, gates, error decomposition, calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.graph import components
from spanloom.operators.segments import _fold
from spanloom.storage import written

_MOST_MS, _IOU_STEPS = 1_000_000_000, 1000


def match_cost(start_error: Column, end_error: Column, iou: Column) -> Column:
    """Boundary error in milliseconds first, then the overlap: what a match adds, always below what another match is worth."""
    error = F.least(F.floor((start_error + end_error) * 1000), F.lit(_MOST_MS))
    return error * (_IOU_STEPS + 1) - F.round(iou * _IOU_STEPS).cast("long")


def _assign(costs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Most pairs, and of these the least cost: shortest augmenting paths over sparse edges (left, right, cost)."""
    by_left: dict[int, list[tuple[int, int]]] = {}
    for p, t, c in costs:
        by_left.setdefault(p, []).append((t, c))
    mate: dict[int, int] = {}  # right to left
    cost_of = {(p, t): c for p, t, c in costs}
    free = set(by_left)
    while free:
        # cheapest path from any free left node to any free right one, over edges and matched edges backwards
        dist = {("p", p): 0 for p in free}
        came: dict[tuple, tuple] = {}
        changed = True
        while changed:
            changed = False
            for p, edges in by_left.items():
                if ("p", p) not in dist:
                    continue
                for t, c in edges:
                    if mate.get(t) != p and dist["p", p] + c < dist.get(("t", t), math.inf):
                        dist["t", t], came["t", t], changed = dist["p", p] + c, ("p", p), True
            for t, p in mate.items():
                if ("t", t) in dist and dist["t", t] - cost_of[p, t] < dist.get(("p", p), math.inf):
                    dist["p", p], came["p", p], changed = dist["t", t] - cost_of[p, t], ("t", t), True
        ends = [(d, t) for (side, t), d in dist.items() if side == "t" and t not in mate]
        if not ends:
            break
        node = ("t", min(ends)[1])
        while node in came:
            before = came[node]
            if node[0] == "t":
                mate[node[1]] = before[1]
            node = before
        free.discard(node[1])
    yield from ((p, t) for t, p in mate.items())


def match_optimal(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one matches of pairs (p, t, cost): as many as can be, and of these the cheapest.

    Pairs are assigned by connected component, so a task holds only what overlaps chain together, not a key's rows.
    Ids of p and t must not clash between keys.
    """
    held = written(pairs.select(*keys, "p", "t", "cost"), "pairs")
    # even numbers for one side, odd ones for the other
    linked = components(held.select((F.col("p") * 2).alias("a"), (F.col("t") * 2 + 1).alias("b")))
    grouped = held.join(linked.select((F.col("node") / 2).cast("long").alias("p"), "component").where("node % 2 = 0"), "p")

    n = len(keys)

    def assign(found: list[tuple]) -> Iterator[tuple]:
        if len(found) == 1:
            yield found[0]
            return
        chosen = set(_assign([row[n:] for row in found]))
        yield from (row for row in found if (row[n], row[n + 1]) in chosen)

    # components are mostly of a few pairs: a task reads many in a stream, and makes no frame of each
    names = [*keys, "p", "t", "cost"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return _fold(grouped, ["component"], ["p", "t", "cost"], names, assign, f"component long, {schema}").drop("component")


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one component taken in order, ends used once."""
    used_p, used_t, kept = set(), set(), []
    for place, p, t in frame.sort_values(["iou", "t", "p"], ascending=[False, True, True])[["p", "t"]].itertuples(name=None):
        if p not in used_p and t not in used_t:
            used_p.add(p), used_t.add(t), kept.append(place)
    return frame.loc[kept].drop(columns="component")


def match_pairs(pairs: DataFrame, keys: Sequence[str], at_once: int = 100_000) -> DataFrame:
    """Greedy one-to-one pairs by iou, then t, then p, within each key: what is the best of both its ends is taken, the rest goes on.

    A pair that is first for its p and for its t would be taken by the greedy order too, so a round of two running
    minimums is part of its result. Chains of falling overlap give up one pair a round, so what a round leaves
    is put into connected components: those of at most ``at_once`` pairs are each worked off in order by one task, larger ones
    go into the next round. Rounds end when nothing is left. Of repeated pairs the one of the largest iou counts; a
    null key, end or iou takes no part.
    """
    rank = F.struct((-F.col("iou")).alias("r"), "t", "p")
    of_p, of_t = [*keys, "p"], [*keys, "t"]
    left = written(pairs.groupBy(*keys, "p", "t").agg(F.max("iou").alias("iou")).dropna(), "pairs")
    taken = [left.limit(0)]
    while left.limit(1).count():
        best_p = left.groupBy(*of_p).agg(F.min(rank).alias("_p"))
        best_t = left.groupBy(*of_t).agg(F.min(rank).alias("_t"))
        good = written(left.join(best_p, of_p).join(best_t, of_t).where((F.col("_p.t") == F.col("t")) & (F.col("_t.p") == F.col("p"))).select(left.columns), "matched")
        left = written(left.join(good.select(*of_p), of_p, "left_anti").join(good.select(*of_t), of_t, "left_anti"), "left")
        taken.append(good)
        if not left.limit(1).count():
            break
        end = lambda side, at: F.struct(*keys, F.lit(side).alias("side"), F.col(at).alias("at"))
        labels = components(left.select(end(0, "p").alias("a"), end(1, "t").alias("b")))
        whole = left.withColumn("node", end(0, "p")).join(labels, "node").drop("node")
        small = whole.groupBy("component").count().where(F.col("count") <= at_once).select("component")
        types = left.select(left.columns).schema
        taken.append(written(whole.join(small, "component").groupBy("component").applyInPandas(_greedy, types), "matched"))
        left = written(whole.join(small, "component", "left_anti").select(left.columns), "left")
    return reduce(DataFrame.unionByName, taken)


def precision_recall(matched: Column, predicted: Column, truth: Column) -> tuple[Column, Column]:
    """Both 1 where there is nothing; without predictions precision is 0, without truth recall is 1."""
    precision = F.when((predicted == 0) & (truth == 0), 1.0).when(predicted > 0, matched / predicted).otherwise(0.0)
    return precision, F.when(truth > 0, matched / truth).otherwise(1.0)


def gate_reasons(metrics: dict[str, Column], floors: dict[str, float], ceilings: dict[str, float]) -> Column:
    """Which thresholds a row of metrics misses, in order."""
    low = [F.when(metrics[k] < v, F.lit(k)) for k, v in floors.items()]
    high = [F.when(metrics[k] > v, F.lit(k)) for k, v in ceilings.items()]
    return F.array_compact(F.array(*low, *high))


def platt_fit(samples: DataFrame, score: str, positive: Column, turns: int = 100) -> DataFrame:
    """One row (a, b, turns) of a sigmoid fitted by Newton steps with halving, on smoothed targets.

    Each turn is one aggregate over all rows (six sums); only these come to the driver. Rows of equal score and label are counted first.
    """
    rows = written(samples.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("x"), positive.alias("y")).agg(F.count("*").alias("n")), "samples")
    ones, zeros = (rows.where("y").agg(F.sum("n")).first()[0] or 0), (rows.where("NOT y").agg(F.sum("n")).first()[0] or 0)
    spark = samples.sparkSession
    if not ones or not zeros:
        return spark.createDataFrame([], "a double, b double, turns int")
    target = F.when(F.col("y"), (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))

    def loss(*at: tuple[float, float]) -> list[float]:
        parts = []
        for a, b in at:
            z = F.col("x") * a + b
            parts.append(F.sum(F.col("n") * F.when(z >= 0, target * z + F.log1p(F.exp(-z))).otherwise((target - 1) * z + F.log1p(F.exp(z)))))
        return list(rows.agg(*parts).first())

    a, b, done = 0.0, math.log(zeros / ones), 0
    value = loss((a, b))[0]
    for _ in range(turns):
        z = F.col("x") * a + b
        p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        d1, d2 = target - p, p * (1 - p)
        s = [F.sum(F.col("n") * e) for e in (F.col("x") * F.col("x") * d2, d2, F.col("x") * d2, F.col("x") * d1, d1)]
        h11, h22, h21, g1, g2 = rows.agg(*s).first()
        h11, h22 = h11 + 1e-12, h22 + 1e-12
        if abs(g1) < 1e-5 and abs(g2) < 1e-5:
            break
        det = h11 * h22 - h21 * h21
        if not det:
            break
        da, db = -(h22 * g1 - h21 * g2) / det, -(-h21 * g1 + h11 * g2) / det
        slope = g1 * da + g2 * db
        steps = [2.0**-k for k in range(34)]  # down to 1e-10
        tried = loss(*((a + s * da, b + s * db) for s in steps))  # one pass for all step sizes
        good = next(((s, v) for s, v in zip(steps, tried, strict=True) if v < value + 1e-4 * s * slope), None)
        if good is None:
            break
        a, b, value, done = a + good[0] * da, b + good[0] * db, good[1], done + 1
    return spark.createDataFrame([(a, b, done)], "a double, b double, turns int")


def upper_bound(n: Column, level: float = 0.05) -> Column:
    """One-sided bound of a rate of which ``n`` trials showed no event."""
    return 1 - F.pow(F.lit(level), 1 / n)


def lag_window(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)
