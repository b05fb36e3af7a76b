"""Spans from ordered atoms and windows: decoding, finalising, segmenting, and machines with hysteresis.

A machine is a small class that takes one row at a time. The batch forms feed it a key's rows in order, cut at
gaps that close it anyway; Python then holds one stretch of rows at a time. Where the stretches begin is told by a
window over the key, which Spark sorts and spills. ``spanloom.streaming.machines`` feeds the same classes from a stream.

Rows with a null key, time, score, weight or kind take no part in the machines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanloom.functions.scores import policy_action
from spanloom.operators.intervals import overlap_join
from spanloom.storage import written

# ---- decoding: runs of anchored atoms to spans


def runs(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of consecutive ordinals that are anchored and not vetoed: keys, first, last, start, end."""
    kept = atoms.where(F.col("anchored") & ~F.col("vetoed"))
    order = Window.partitionBy(*keys).orderBy("ordinal")
    grouped = kept.withColumn("_run", F.col("ordinal") - F.row_number().over(order)).groupBy(*keys, "_run")
    return grouped.agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min_by("start", "ordinal").alias("start"), F.max_by("end", "ordinal").alias("end")).drop("_run")


def merge_adjacent(found: DataFrame, atoms: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """Neighbouring runs less than ``gap`` apart as one, unless a vetoed atom or a break lies between."""
    barred = atoms.where("vetoed OR is_break").select(*keys, "ordinal")
    order = Window.partitionBy(*keys).orderBy("first")
    pairs = found.withColumns({"_l": F.lag("last").over(order), "_e": F.lag("end").over(order)})
    # the last barred ordinal ahead of each run tells whether one lies behind the run before
    marks = pairs.select(*keys, F.col("first").alias("at"), F.lit(0).alias("_side")).unionByName(barred.select(*keys, F.col("ordinal").alias("at"), F.lit(1).alias("_side")))
    behind = Window.partitionBy(*keys).orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last_barred = marks.withColumn("_b", F.max(F.when(F.col("_side") == 1, F.col("at"))).over(behind)).where("_side = 0").select(*keys, F.col("at").alias("first"), "_b")
    seen = pairs.join(last_barred, [*keys, "first"])
    apart = F.col("start") - F.col("_e")
    joins = (apart >= 0) & (apart < gap) & ~F.coalesce(F.col("_b") > F.col("_l"), F.lit(False))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    grouped = seen.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(upto)).groupBy(*keys, "_g")
    return grouped.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("start", "first").alias("start"), F.max_by("end", "first").alias("end")).drop("_g")


def _pieces(atoms: list[tuple], longest: float) -> Iterator[tuple]:
    """Of a span's atoms (ordinal, start, end, loose) in order, the pieces: first, last, start, end."""
    waiting = [(0, len(atoms))]
    while waiting:
        a, b = waiting.pop()
        start, end = min(x[1] for x in atoms[a:b]), max(x[2] for x in atoms[a:b])
        if end - start <= longest or b - a == 1:  # one atom is a piece whatever its length
            yield atoms[a][0], atoms[b - 1][0], start, end
            continue
        gap, at = None, a
        while at < b:
            if not atoms[at][3]:
                at += 1
                continue
            to = at
            while to < b and atoms[to][3]:
                to += 1
            if a < at and to < b and (gap is None or to - at > gap[1] - gap[0]):
                gap = (at, to)
            at = to
        if gap is None:
            middle = (atoms[a][0] + atoms[b - 1][0]) // 2
            gap = (sum(x[0] < middle for x in atoms[a:b]) + a, sum(x[0] <= middle for x in atoms[a:b]) + a)
        waiting += [(x, y) for x, y in ((gap[1], b), (a, gap[0])) if x < y]


def split_long(spans: DataFrame, atoms: DataFrame, keys: Sequence[str], longest: float) -> DataFrame:
    """Spans over ``longest`` cut at their longest stretch of unanchored atoms (the first of equal ones), or at the middle ordinal, until all fit.

    A span of one atom stays as it is. Spans of a key don't overlap, so an ordered pass tells each atom its
    long span; these alone are cut, one at a time, whatever the number of cuts.
    """
    names = [*keys, "first", "last", "start", "end"]
    types = {f.name: f.dataType.simpleString() for f in spans.schema}
    long = spans.where(F.col("end") - F.col("start") > longest)
    order = Window.partitionBy(*keys).orderBy("ordinal", F.desc("_last")).rowsBetween(Window.unboundedPreceding, 0)
    marks = long.select(*keys, F.col("first").alias("ordinal"), F.lit(None).cast(types["start"]).alias("start"), F.lit(None).cast(types["end"]).alias("end"), F.lit(None).cast("boolean").alias("loose"), F.col("last").alias("_last"))
    rows = atoms.select(*keys, "ordinal", F.col("start").cast(types["start"]).alias("start"), F.col("end").cast(types["end"]).alias("end"), (F.col("vetoed") | ~F.col("anchored")).alias("loose"), F.lit(None).cast(types["last"]).alias("_last"))
    owned = marks.unionByName(rows).withColumns({"_root": F.last(F.when(F.col("_last").isNotNull(), F.col("ordinal")), ignorenulls=True).over(order), "_to": F.last("_last", ignorenulls=True).over(order)})
    inside = owned.where(F.col("_last").isNull() & (F.col("ordinal") <= F.col("_to")))
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"_root {types['first']}", *(f"{n} {types[n]}" for n in names[len(keys) :])])
    cut = _fold(inside, [*keys, "_root"], ["ordinal"], ["ordinal", "start", "end", "loose"], lambda found: _pieces(found, longest), schema)
    return spans.where(F.col("end") - F.col("start") <= longest).select(names).unionByName(cut.select(names))


def snap(spans: DataFrame, atoms: DataFrame, keys: Sequence[str], radius: float, bucket: int) -> DataFrame:
    """Starts go to the first break within the radius, ends to the last one."""
    hints = atoms.where("is_break").select(*keys, "ordinal", F.col("start").alias("bs"), F.col("end").alias("be"))

    def near(edge: str, at: str) -> DataFrame:
        around = spans.select(*keys, F.col("first").alias("_f"), (F.col(edge) - radius).alias("start"), (F.col(edge) + radius).alias("end"))
        points = hints.select(*keys, "ordinal", F.col(at).alias("start"), F.col(at).alias("end"), "bs", "be")
        # both ends count, so the points are widened by a hair on either side
        eps = 1e-6
        wide = points.withColumns({"start": F.col("start") - eps, "end": F.col("end") + eps})
        return overlap_join(around, wide, keys, bucket).where((F.col(f"b.{at}") >= F.col("a.start")) & (F.col(f"b.{at}") <= F.col("a.end")))

    left = near("start", "bs").groupBy(*keys, F.col("a._f").alias("first")).agg(F.min(F.struct("b.ordinal", "b.bs")).alias("_l"))
    right = near("end", "be").groupBy(*keys, F.col("a._f").alias("first")).agg(F.max(F.struct("b.ordinal", "b.be")).alias("_r"))
    both = spans.join(left, [*keys, "first"], "left").join(right, [*keys, "first"], "left")
    return both.select(*keys, F.coalesce("_l.ordinal", "first").alias("first"), F.coalesce("_r.ordinal", "last").alias("last"), F.coalesce("_l.bs", "start").alias("start"), F.coalesce("_r.be", "end").alias("end"))


def resolve_overlap(spans: DataFrame, atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A span that begins within the one before begins behind it; what has nothing left goes."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    before = spans.withColumn("_l", F.lag("last").over(order)).withColumn("_first", F.when(F.col("first") <= F.col("_l"), F.col("_l") + 1).otherwise(F.col("first")))
    clipped = before.where("_first <= last").withColumn("_moved", F.col("_first") > F.col("first"))
    times = atoms.select(*keys, F.col("ordinal").alias("_first"), F.col("start").alias("_s"))
    joined = clipped.join(times, [*keys, "_first"], "left")
    return joined.select(*keys, F.col("_first").alias("first"), "last", F.when(F.col("_moved"), F.coalesce("_s", "start")).otherwise(F.col("start")).alias("start"), "end")


def decode(atoms: DataFrame, keys: Sequence[str], gap: float = 3.0, longest: float = 180.0, radius: float = 8.0, shortest: float = 5.0, bucket: int = 600) -> DataFrame:
    """Atoms (ordinal, start, end, anchored, vetoed, is_break) to spans: runs, merged, split, snapped, clipped, long enough."""
    spans = merge_adjacent(runs(atoms, keys), atoms, keys, gap)
    spans = resolve_overlap(snap(split_long(spans, atoms, keys, longest), atoms, keys, radius, bucket), atoms, keys)
    return spans.where(F.col("end") - F.col("start") >= shortest)


# ---- folding stretches


def _fold(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows (``columns``) of each group of ``by``, in order; its rows come behind the group's keys.

    Spark sorts (and spills); a task reads its groups one behind the other, across Arrow batches, and holds one of
    them. Rows with a null key take no part.
    """
    some = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in by)))
    picked = some.select(*dict.fromkeys([*by, *columns, *order]))
    # dealt out by a hash of the key, not the key: an exchange by the key itself is left out above a union of sides that are dealt out so,
    # whose partitions are then not put together
    ordered = picked.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).select(*by, *columns)
    width, out_schema = len(by), to_arrow_schema(StructType.fromDDL(schema))

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != key:
                    found += [(*key, *r) for r in fold(held)] if held else []
                    key, held = row[:width], []
                held.append(row[width:])
            if found:
                yield packed(found)
        if held:
            yield packed([(*key, *r) for r in fold(held)])

    return ordered.mapInArrow(run, schema)


# ---- segmenting turns


def segment(atoms: DataFrame, keys: Sequence[str], longest: float = 120.0, pause: float = 1.5, shortest: float = 10.0) -> DataFrame:
    """Atoms (ordinal, start, end, soft) with ``segment``, from 0, by key.

    A pause is a hard break and so is a segment's length; ``soft`` marks breaks that count once a segment is long
    enough. Where a segment ends depends on where it began, so stretches between pauses are folded by themselves.
    """
    order = Window.partitionBy(*keys).orderBy("ordinal")
    gap = F.col("start") - F.lag("end").over(order)
    cut = atoms.withColumn("_h", F.when(F.coalesce(gap >= pause, F.lit(True)), 1).otherwise(0)).withColumn("_stretch", F.sum("_h").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    def fold(rows: list[tuple]) -> Iterator[tuple]:
        began, end = None, None
        for ordinal, start, stop, soft in rows:
            new = began is None or start - began >= longest or (soft and end - began >= shortest)
            began, end = start if new else began, stop
            yield ordinal, bool(new)

    types = {f.name: f.dataType.simpleString() for f in cut.schema}
    by = [*keys, "_stretch"]
    folded = _fold(cut, by, ["ordinal"], ["ordinal", "start", "end", "soft"], fold, ", ".join(f"{n} {types[n]}" for n in [*by, "ordinal"]) + ", _new boolean")
    place = F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return folded.withColumn("segment", place).drop("_new", "_stretch")


# ---- hysteresis


@dataclass
class Hysteresis:
    """Segments of scored windows: opened by one high or two nearby good scores, kept by fair ones, closed by a lull or a gap."""

    candidate: float = 0.35
    stay: float = 0.28
    promote: float = 0.40
    high: float = 0.60
    nearby: int = 2
    near: float = 90.0
    lull: float = 3.0
    gap: float = 5.0
    shortest: float = 30.0
    pending: list = field(default_factory=list)  # (start, end, score) of windows that may yet belong to a segment
    open: dict | None = None

    def _add(self, start: float, end: float, score: float) -> None:
        o = self.open
        o["sum"] += score * (end - start)
        o["length"] += end - start
        o["n"] += 1

    def _close(self) -> dict:
        o, self.open = self.open, None
        mean = o["sum"] / o["length"] if o["length"] > 0 else 0.0
        return {"start": o["start"], "end": o["end"], "score": mean, "n": o["n"], "promoted": mean >= self.promote and o["end"] - o["start"] >= self.shortest}

    def _begin(self, windows: list) -> None:
        windows = sorted(windows, key=lambda w: w[0])
        self.pending = []
        self.open = {"start": min(w[0] for w in windows), "end": max(w[1] for w in windows), "sum": 0.0, "length": 0.0, "n": 0, "below": 0.0, "tail": [0.0, 0.0, 0, float("-inf")]}
        for i, w in enumerate(windows):
            if i == 0 or w != windows[i - 1]:
                self._add(*w)

    def _idle(self, w: tuple) -> None:
        start, _, score = w
        if score >= self.high:
            self._begin([w])
            return
        self.pending = [p for p in self.pending if start - p[1] <= self.near]
        if score >= self.stay:
            self.pending.append(w)
        if score >= self.candidate and sum(p[2] >= self.candidate for p in self.pending) >= self.nearby:
            self._begin(self.pending)

    def take(self, start: float, end: float, score: float) -> dict | None:
        """The segment that this window closes, if any."""
        w, o = (start, end, score), self.open
        if o is None:
            self._idle(w)
            return None
        gap = max(0.0, start - o["end"])
        if score >= self.stay:
            if gap > self.gap:
                done = self._close()
                self._idle(w)
                return done
            if end >= o["tail"][3]:  # what lay behind the extent is inside it now
                o["sum"], o["length"], o["n"] = o["sum"] + o["tail"][0], o["length"] + o["tail"][1], o["n"] + o["tail"][2]
            o["tail"] = [0.0, 0.0, 0, float("-inf")]
            self._add(*w)
            o["end"], o["below"] = end, 0.0
            return None
        if end <= o["end"]:
            self._add(*w)
        else:
            t = o["tail"]
            o["tail"] = [t[0] + score * (end - start), t[1] + end - start, t[2] + 1, max(t[3], end)]
        o["below"] += end - start
        return self._close() if gap > self.gap or o["below"] >= self.lull else None

    def finish(self) -> dict | None:
        return self._close() if self.open else None


SEGMENT = "start double, end double, score double, n int, promoted boolean"


def hysteresis_segments(windows: DataFrame, keys: Sequence[str], key_types: str, **config: float) -> DataFrame:
    """Windows (start, end, score) to segments: keys, start, end, score, n, promoted.

    A gap beyond ``near`` empties a machine, so a key is cut there.
    """
    windows = windows.where("start IS NOT NULL AND end IS NOT NULL AND score IS NOT NULL")
    machine = Hysteresis(**config)
    reach = max(machine.near, machine.gap)
    order = Window.partitionBy(*keys).orderBy("start", "end", "score")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = windows.withColumn("_new", F.when(F.coalesce(F.col("start") - ahead > reach, F.lit(True)), 1).otherwise(0)).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        m = Hysteresis(**config)
        for found in [*(m.take(*map(float, r)) for r in rows), m.finish()]:
            if found:
                yield tuple(found[c] for c in ("start", "end", "score", "n", "promoted"))

    return _fold(cut, [*keys, "_stretch"], ["start", "end", "score"], ["start", "end", "score"], fold, f"{key_types}, _stretch long, {SEGMENT}").drop("_stretch")


# ---- finalising

_SEVERITY = ("eligible", "markOnly", "blockedByPolicy")


def _resolve(spans: list[dict]) -> list[dict]:
    """No two spans overlap: the more confident one keeps its extent (the earlier of equals)."""
    changed = True
    while changed:
        changed = False
        spans.sort(key=lambda s: (s["start"], s["id"]))
        i = 0
        while i < len(spans) - 1:
            a, b = spans[i], spans[i + 1]
            if a["end"] <= b["start"]:
                i += 1
                continue
            changed = True
            if a["confidence"] >= b["confidence"]:
                if a["end"] >= b["end"]:
                    del spans[i + 1]
                else:
                    b["start"], b["gate"] = a["end"], max(b["gate"], 1)
            elif b["start"] <= a["start"] and b["end"] >= a["end"]:
                del spans[i]
            else:
                a["end"], a["gate"] = b["start"], max(a["gate"], 1)
    return spans


def _shape(spans: list[dict], gap: float, shortest: float, longest: float) -> Iterator[dict]:
    """Close spans as one, too short ones left out, too long ones in pieces."""
    merged: list[dict] = []
    for s in _resolve(spans):
        if merged and s["start"] - merged[-1]["end"] < gap:
            m = merged[-1]
            m.update(end=s["end"], confidence=max(m["confidence"], s["confidence"]), gate=max(m["gate"], s["gate"], 1))
        else:
            merged.append(s)
    for s in merged:
        length = s["end"] - s["start"]
        if length < shortest:
            continue
        if length <= longest:
            yield s
        elif length < longest + shortest:
            yield s | {"gate": max(s["gate"], 1)}
        else:
            n = int(length // longest) + (length % longest >= shortest)
            for k in range(n):
                last = k == n - 1
                yield s | {"id": s["id"] if last else f"{s['id']}#split-{k}", "start": s["start"] + k * longest, "end": s["end"] if last else s["start"] + (k + 1) * longest, "gate": max(s["gate"], 1)}


def finalize(spans: DataFrame, chapters: DataFrame, durations: DataFrame, keys: Sequence[str], key_types: str, bucket: int, gap: float = 3.0, shortest: float = 5.0, longest: float = 180.0, share: float = 0.5) -> DataFrame:
    """Spans (id string, start, end, confidence, intent, ownership) as they may act: keys, id, start, end, confidence, gate, action.

    1 to 3, overlaps, close neighbours and lengths, touch only spans that chain together, and run on these by themselves.
    4: spans that cross a content chapter (start, end) are marks only. 5: of a key's eligible spans the least confident,
    the later of equals first, are blocked until the rest fits ``share`` of the key's duration. 6: action by intent and ownership.
    """
    fields = ["id", "start", "end", "confidence", "intent", "ownership"]
    order = Window.partitionBy(*keys).orderBy("start", "end", "id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = spans.withColumn("_new", F.when(F.coalesce(F.col("start") - reach >= gap, F.lit(True)), 1).otherwise(0)).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        for s in _shape([dict(zip(fields, r, strict=True), gate=0) for r in rows], gap, shortest, longest):
            yield tuple(s[c] for c in (*fields, "gate"))

    shaped = _fold(chained, [*keys, "_chain"], ["start", "id"], fields, fold, f"{key_types}, _chain long, id string, start double, end double, confidence double, intent string, ownership string, gate int").drop("_chain")
    shaped = written(shaped, "shaped")
    crossed = overlap_join(shaped, chapters, keys, bucket).select(*keys, F.col("a.id").alias("id"), F.col("a.start").alias("start")).distinct().withColumn("_c", F.lit(1))
    marked = shaped.join(crossed, [*keys, "id", "start"], "left").withColumn("gate", F.greatest("gate", F.coalesce("_c", F.lit(0)))).drop("_c")
    length = F.when(F.col("gate") == 0, F.col("end") - F.col("start")).otherwise(0.0)
    weakest = Window.partitionBy(*keys).orderBy((F.col("gate") > 0).cast("int"), "confidence", F.desc("start"), F.desc("id"))
    sums = marked.join(durations, list(keys), "left").withColumns({"_len": length, "_all": F.sum(length).over(Window.partitionBy(*keys))}).withColumn("_before", F.sum("_len").over(weakest) - F.col("_len"))
    excess = F.col("_all") - F.col("duration") * share
    capped = sums.withColumn("gate", F.when((F.col("gate") == 0) & (F.col("duration") > 0) & (F.col("_before") < excess), 2).otherwise(F.col("gate")))
    name = F.get(F.array(*map(F.lit, _SEVERITY)), F.col("gate"))
    return capped.select(*keys, "id", "start", "end", "confidence", name.alias("gate"), policy_action(F.col("intent"), F.col("ownership")).alias("action"))


# ---- hypotheses


@dataclass
class Hypotheses:
    """Evidence as it comes to spans: anchors open or feed a hypothesis whose window they fall in, closing marks and idleness end it."""

    confirm: float = 2.5
    decay: float = 0.95
    idle: float = 20.0
    radii: dict = field(default_factory=lambda: {"disclosure": (15, 90), "sponsor": (15, 90), "url": (75, 15), "promo": (75, 15), "fm": (30, 30), "transition": (60, 5)})
    active: list = field(default_factory=list)

    def _score(self, h: dict, at: float) -> float:
        return sum(w * self.decay ** max(0.0, at - t) for t, w in h["evidence"])

    def _close(self, h: dict, why: str, at: float) -> dict:
        score = self._score(h, h["last"])
        return {"start": h["start"], "end": max(h["end"], h["last"]), "confidence": min(1.0, score / max(self.confirm, 1.0)), "n": len(h["evidence"]), "confirmed": h["confirmed"], "reason": why}

    def _absorb(self, h: dict, start: float, end: float, weight: float) -> None:
        h["evidence"].append((start, weight))
        h["start"], h["end"], h["last"] = min(h["start"], start), max(h["end"], end), max(h["last"], end)
        h["confirmed"] = h["confirmed"] or self._score(h, h["last"]) >= self.confirm

    def _best(self, at: float) -> dict | None:
        near = [h for h in self.active if h["start"] - h["back"] <= at <= h["end"] + h["ahead"]]
        return max(near, key=lambda h: (h["last"], -h["start"]), default=None)

    def take(self, start: float, end: float, kind: str, weight: float) -> list[dict]:
        """Spans that this piece of evidence closes. ``return`` ends a hypothesis, ``body`` feeds but opens none, ``url`` and ``promo`` close what is open."""
        out = [self._close(h, "idleGap", start) for h in self.active if start - h["last"] > self.idle]
        self.active = [h for h in self.active if start - h["last"] <= self.idle]
        h = self._best(start)
        if h is None:
            if kind in self.radii:
                back, ahead = self.radii[kind]
                h = {"start": start, "end": end, "last": end, "evidence": [(start, weight)], "back": back, "ahead": ahead, "confirmed": weight >= self.confirm}
                self.active.append(h)
            return out
        self._absorb(h, start, end, weight)
        if kind in ("return", "url", "promo"):
            self.active.remove(h)
            out.append(self._close(h, "returnMarker" if kind == "return" else "explicitClose", end))
        return out

    def finish(self, at: float) -> list[dict]:
        out = [self._close(h, "timeout", at) for h in self.active]
        self.active = []
        return out


HYPOTHESIS = "start double, end double, confidence double, n int, confirmed boolean, reason string"


def hypotheses(evidence: DataFrame, keys: Sequence[str], key_types: str, **config: float) -> DataFrame:
    """Evidence (start, end, kind, weight) in order to spans. After an idle gap nothing is active, so a key is cut there; what a gap ends counts as idle. Evidence of an unknown kind takes no part."""
    machine = Hypotheses(**config)
    known = ("return", "body", *machine.radii)
    evidence = evidence.where(F.col("kind").isin(*known) & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("weight").isNotNull())
    idle = machine.idle
    order = Window.partitionBy(*keys).orderBy("start", "end", "kind")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = evidence.withColumn("_new", F.when(F.coalesce(F.col("start") - ahead > idle, F.lit(True)), 1).otherwise(0)).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("_final", F.max("_stretch").over(Window.partitionBy(*keys)) == F.col("_stretch"))

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        m, out, end = Hypotheses(**config), [], 0.0
        for start, stop, kind, weight, _ in rows:
            out += m.take(float(start), float(stop), kind, float(weight))
            end = max(end, float(stop))
        out += [x if rows[0][4] else x | {"reason": "idleGap"} for x in m.finish(end)]
        for x in out:
            yield tuple(x[c] for c in ("start", "end", "confidence", "n", "confirmed", "reason"))

    return _fold(cut, [*keys, "_stretch"], ["start", "end", "kind"], ["start", "end", "kind", "weight", "_final"], fold, f"{key_types}, _stretch long, {HYPOTHESIS}").drop("_stretch")


def live_skips(scores: DataFrame, keys: Sequence[str], enter: float = 0.65, stay: float = 0.45, gap: float = 4.0, shortest: float = 15.0, sure: float = 0.85) -> DataFrame:
    """Windows that enter at a high score and stay at a fair one, near ones merged; short spans only if sure: keys, start, end, top.

    A window is in if, of the windows since the last one below ``stay``, one reached ``enter`` at or before it.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stretch = scores.withColumn("_s", F.sum((F.col("score") < stay).cast("int")).over(upto))
    entered = F.max((F.col("score") >= enter).cast("int")).over(Window.partitionBy(*keys, "_s").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    inside = stretch.withColumn("_in", entered).where((F.col("_in") == 1) & (F.col("score") >= stay))
    top = inside.withColumn("_k", F.floor(F.col("score") * 1_000_000).cast("long"))
    spans = _islands_max(top, keys, gap)
    return spans.where((F.col("end") - F.col("start") >= shortest) | (F.col("top") >= sure))


def _islands_max(rows: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") - reach >= gap), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(upto)).groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("top")).drop("_g")


def boundary_scores(points: DataFrame, cues: DataFrame, keys: Sequence[str], reach: int, weights: dict[str, float]) -> DataFrame:
    """Each point (id, at) with the cue (at, cue, strength) that scores best: weight times strength less a share for distance; null if none is within reach."""
    around = points.select(*keys, "id", F.col("at").alias("_at"), (F.col("at") - reach).alias("start"), (F.col("at") + reach + 1).alias("end"))
    spots = cues.select(*keys, F.col("at").alias("start"), (F.col("at") + 1).alias("end"), "cue", "strength")
    near = overlap_join(around, spots, keys, bucket=max(1, 4 * reach))
    weight = F.coalesce(*(F.when(F.col("b.cue") == c, F.lit(w)) for c, w in weights.items()), F.lit(0.0))
    score = F.round(weight * F.col("b.strength") * (1 - F.abs(F.col("b.start") - F.col("a._at")) / reach), 9)
    best = near.groupBy(*keys, F.col("a.id").alias("id")).agg(F.min(F.struct((-score).alias("s"), F.abs(F.col("b.start") - F.col("a._at")).alias("d"), F.col("b.start").alias("at"))).alias("_b"))
    return points.select(*keys, "id").join(best, [*keys, "id"], "left").select(*keys, "id", F.col("_b.at").alias("snapped"), (-F.col("_b.s")).alias("score"))
