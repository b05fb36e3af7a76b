"""Brackets of music around spans: a machine of a few dozen states, scanned in pieces that are put together afterwards.

A window is one of eight symbols (does music begin, does it last, does it end), and a symbol maps every state to the
next one. What a stretch of windows does to every state is a table; tables of neighbouring stretches are put together
in any grouping, so the windows of one long span are scanned by many tasks, and what is folded in order is one table a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.intervals import overlap_join
from spanloom.operators.segments import _fold

#: Sustained windows count for the score up to here.
FULL_BED = 5
_NONE, _BEGIN, _DROP, _END, _TRAIL = range(5)


@dataclass(frozen=True)
class Bracket:
    """Thresholds: where music begins, lasts and ends, how many windows may lie between, and what a sharp start and a fade are."""

    onset: float = 0.3
    bed: float = 0.25
    offset: float = 0.3
    least_bed: int = 2
    onset_gap: int = 2
    dropouts: int = 6
    sharp: float = 1.5
    fade: float = 0.15
    fade_windows: int = 3

    @cached_property
    def states(self) -> list[tuple]:
        beds = range(1, max(FULL_BED, self.least_bed) + 1)
        return [("idle",), *(("onset", k) for k in range(self.onset_gap + 1)), *(("bed", c, d) for c in beds for d in range(self.dropouts)), *(("offset", c, t) for c in beds for t in range(self.fade_windows)), *(("done", c) for c in beds)]

    def step(self, state: tuple, begins: bool, lasts: bool, ends: bool) -> tuple[tuple, int]:
        """The next state, and what happens: a start is noted or dropped, an end noted, a window behind it."""
        kind = state[0]
        if kind == "idle":
            return (("onset", 0), _BEGIN) if begins else (state, _NONE)
        if kind == "onset":
            if lasts:
                return ("bed", 1, 0), _NONE
            return (("idle",), _DROP) if state[1] + 1 > self.onset_gap else (("onset", state[1] + 1), _NONE)
        if kind == "bed":
            c, d = (min(state[1] + 1, max(FULL_BED, self.least_bed)), 0) if lasts else (state[1], state[2] + 1)
            if d >= self.dropouts:
                return ("idle",), _DROP
            return (("offset", c, 0), _END) if ends and c >= self.least_bed else (("bed", c, d), _NONE)
        if kind == "offset":
            return (("done", state[1]) if state[2] + 1 >= self.fade_windows else ("offset", state[1], state[2] + 1)), _TRAIL
        return state, _NONE

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state and happening by symbol and state."""
        number = {s: i for i, s in enumerate(self.states)}
        moves = [[self.step(s, bool(x & 1), bool(x & 2), bool(x & 4)) for s in self.states] for x in range(8)]
        return np.array([[number[s] for s, _ in row] for row in moves]), np.array([[what for _, what in row] for row in moves])

    def sustained(self, state: int) -> int:
        s = self.states[state]
        return s[1] if s[0] in ("bed", "offset", "done") else 0


_TABLE = "ends array<int>, began array<int>, began_at array<double>, began_level array<double>, began_score array<double>, ended array<int>, ended_at array<double>, ended_score array<double>, trail array<array<double>>"


def _stretch(rows: list[tuple], config: Bracket) -> tuple:
    """What windows (symbol, start, end, level, onset, offset) do to every state. ``began``: 0 as before, 1 noted here, 2 dropped."""
    move, happens = config.tables
    n = len(config.states)
    at = np.arange(n)
    began, ended = np.zeros(n, np.int64), np.zeros(n, np.int64)
    notes = {k: np.zeros(n) for k in ("began_at", "began_level", "began_score", "ended_at", "ended_score")}
    trail: list[list[float]] = [[] for _ in range(n)]
    for symbol, start, end, level, onset, offset in rows:
        what = happens[symbol][at]
        at = move[symbol][at]
        if what.any():
            began[what == _BEGIN], began[what == _DROP], ended[what == _END] = 1, 2, 1
            for name, kind, value in (("began_at", _BEGIN, start), ("began_level", _BEGIN, level), ("began_score", _BEGIN, onset), ("ended_at", _END, end), ("ended_score", _END, offset)):
                notes[name][what == kind] = value
            for k in np.flatnonzero(what == _TRAIL):
                trail[k].append(level)
    whole = lambda x: x.tolist()
    return whole(at), whole(began), whole(notes["began_at"]), whole(notes["began_level"]), whole(notes["began_score"]), whole(ended), whole(notes["ended_at"]), whole(notes["ended_score"]), trail


def composed(first: tuple, then: tuple) -> tuple:
    """What two neighbouring stretches do, one behind the other."""
    via = first[0]
    pick = lambda column: [then[column][s] for s in via]
    began, ended = pick(1), pick(5)
    later = lambda column, touched: [x if t else old for x, t, old in zip(pick(column), touched, first[column], strict=True)]
    return (
        pick(0), [t or old for t, old in zip(began, first[1], strict=True)], later(2, began), later(3, began), later(4, began),
        [t or old for t, old in zip(ended, first[5], strict=True)], later(6, ended), later(7, ended), [a + b for a, b in zip(first[8], pick(8), strict=True)],
    )


def window_length(windows: DataFrame, keys: Sequence[str], otherwise: float = 2.0) -> DataFrame:
    """keys, length: what lies between a key's first two starts; ``otherwise`` for a key of one window."""
    first = windows.groupBy(*keys).agg(F.min("start").alias("_first"))
    seen = windows.join(first, list(keys)).groupBy(*keys).agg(F.count_if(F.col("start") == F.col("_first")).alias("_n"), (F.min(F.when(F.col("start") > F.col("_first"), F.col("start"))) - F.any_value("_first")).alias("_gap"))
    return seen.select(*keys, F.when(F.col("_n") > 1, 0.0).otherwise(F.coalesce("_gap", F.lit(otherwise))).alias("length"))


def brackets(windows: DataFrame, spans: DataFrame, keys: Sequence[str], key_types: str, bucket: int = 600, stretch: float = 1024.0, config: Bracket = Bracket()) -> DataFrame:  # noqa: B008
    """Spans (id long, start, end, trust) with the bracket around them: keys, id, onset, offset, template, score. Spans without one have no row.

    Windows have start, end, level, onset, offset, music. Those within five windows' lengths of a span count, in order of start, end, and there must be
    three; ``stretch`` seconds of them are scanned at once. Null scores and levels are 0; windows without times, and spans without times or trust, take no part.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    there = windows.where("start IS NOT NULL AND end IS NOT NULL").select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), *map(zero, ("level", "onset", "offset", "music")))
    own = spans.where("start IS NOT NULL AND end IS NOT NULL AND trust IS NOT NULL").join(window_length(there, keys), list(keys))
    reach = own.select(*keys, F.col("id").cast("long").alias("id"), F.col("trust").cast("double").alias("trust"), "length", F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_e"))
    margin = F.col("length") * 5
    around = reach.withColumns({"start": F.col("_s") - margin - 1, "end": F.col("_e") + margin + 1})
    near = overlap_join(around, there, keys, bucket)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    close = near.where((b("end") >= a("_s") - a("length") * 5) & (b("start") <= a("_e") + a("length") * 5))
    flag = lambda test, value: F.when(test, value).otherwise(0)
    symbol = flag((b("onset") >= config.onset) & (b("start") <= a("_s") + a("length")), 1) + flag(b("music") >= config.bed, 2) + flag((b("offset") >= config.offset) & (b("start") >= a("_e") - a("length")), 4)
    rows = close.select(*keys, a("id").alias("id"), symbol.alias("symbol"), *(b(c).alias(c) for c in ("start", "end", "level", "onset", "offset")), F.floor(b("start") / stretch).alias("stretch"))
    tables = _fold(rows, [*keys, "id", "stretch"], ["start", "end", "symbol", "level"], ["symbol", "start", "end", "level", "onset", "offset"], lambda found: [(*_stretch(found, config), len(found), sum(r[3] for r in found))], f"{key_types}, id long, stretch long, {_TABLE}, n long, levels double")

    def together(found: list[tuple]) -> Iterator[tuple]:
        whole = found[0][:9]
        for more in found[1:]:
            whole = composed(whole, more[:9])
        ends, began, at, level, score, ended, end_at, end_score, trail = (x[0] for x in whole)  # from the idle state
        n, levels = sum(r[9] for r in found), sum(r[10] for r in found)
        yield n, levels / n, config.sustained(ends), *((at, level, score) if began == 1 else (None, None, None)), *((end_at, end_score) if ended else (None, None)), trail

    columns = [f.split()[0] for f in _TABLE.split(", ")] + ["n", "levels"]
    scanned = _fold(tables, [*keys, "id"], ["stretch"], columns, together, f"{key_types}, id long, n long, mean double, sustained int, on double, on_level double, on_score double, off double, off_score double, trail array<double>")
    return _described(scanned.where("n >= 3").join(reach, [*keys, "id"]), keys, config)


def _fades(trail: Column, rate: float) -> Column:
    """Whether more than half of the steps (rounded down) fall by the rate."""
    pairs = F.transform(trail, lambda x, i: F.when((i > 0) & (F.get(trail, i - 1) > 0) & ((F.get(trail, i - 1) - x) / F.get(trail, i - 1) >= rate), 1).otherwise(0))
    return (F.size(trail) >= 2) & (F.aggregate(pairs, F.lit(0), lambda s, x: s + x) > F.floor((F.size(trail) - 1) / 2))


def _described(found: DataFrame, keys: Sequence[str], config: Bracket) -> DataFrame:
    on, off = F.col("on").isNotNull(), F.col("off").isNotNull()
    on_score, off_score = F.coalesce("on_score", F.lit(0.0)), F.coalesce("off_score", F.lit(0.0))
    sharp = (F.col("mean") > 0) & (F.round(F.col("on_level") / F.col("mean"), 9) >= config.sharp)  # whatever the order of adding was
    fades = _fades(F.col("trail"), config.fade)
    alike = (on_score > 0) & (off_score > 0) & (F.least(on_score, off_score) / F.greatest(on_score, off_score) >= 0.5)
    whole = F.when(sharp & fades, "hardInFadeOut").when(sharp, "stingInBedDryOut").when(~fades & alike, "symmetricBracket").when(off_score > on_score, "dryInStingOut").otherwise("stingInBedDryOut")
    template = F.when(on & off, whole).when(on, "partialOnset").otherwise("partialOffset")
    score = F.when(on & off, 0.4).otherwise(0.15) + F.least(on_score, F.lit(1.0)) * 0.15 + F.least(off_score, F.lit(1.0)) * 0.15 + F.least(F.col("sustained") / FULL_BED, F.lit(1.0)) * 0.15
    trusted = F.least(F.greatest(score * (0.5 + 0.5 * F.col("trust")), F.lit(0.0)), F.lit(1.0))
    return found.where(on | off).select(*keys, "id", F.coalesce("on", "_s").alias("onset"), F.coalesce("off", "_e").alias("offset"), template.alias("template"), trusted.alias("score"))
