"""The span machines on streams: the same classes as the batch forms, their state kept by Spark for each key."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.segments import HYPOTHESIS, SEGMENT, Hypotheses, Hysteresis


def _stateful(rows: DataFrame, keys: Sequence[str], at: str, late: str, order: Sequence[str], schema: str, start: Callable[[str | None], object], step: Callable[[object, tuple], list[dict]], finish: Callable[[object], list[dict]], idle_ms: int) -> DataFrame:
    """Rows of a key in order through a machine; a key that is silent for longer than ``idle_ms`` of event time is finished.

    Rows later than ``late`` are dropped; rows that come together are put in order, those of different batches are taken as they come.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = start(state.get[0] if state.exists else None)
        out: list[dict] = []
        if state.hasTimedOut:
            out = finish(machine)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values([*order])
            for row in rows[[*order]].itertuples(index=False, name=None):
                out += step(machine, row)
            state.update((json.dumps(dataclasses.asdict(machine)),))
            last = int(rows[at].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *(x[c] for c in names[len(keys) :])) for x in out], columns=names)

    return rows.withWatermark(at, late).groupBy(*keys).applyInPandasWithState(run, schema, "machine string", "append", GroupStateTimeout.EventTimeTimeout)


def hysteresis_segments(windows: DataFrame, keys: Sequence[str], key_types: str, at: str = "ts", late: str = "1 minute", **config: float) -> DataFrame:
    """Windows (ts, start, end, score) of a stream to segments, as ``segments.hysteresis_segments`` gives them."""

    def start(kept: str | None) -> Hysteresis:
        machine = Hysteresis(**(json.loads(kept) if kept else config))
        machine.pending = [tuple(p) for p in machine.pending]
        return machine

    def step(machine: Hysteresis, row: tuple) -> list[dict]:
        found = machine.take(*map(float, row))
        return [found] if found else []

    idle = max(Hysteresis(**config).near, Hysteresis(**config).gap)
    return _stateful(windows, keys, at, late, ["start", "end", "score"], f"{key_types}, {SEGMENT}", start, step, lambda m: [x for x in [m.finish()] if x], int(idle * 1000))


def hypotheses(evidence: DataFrame, keys: Sequence[str], key_types: str, at: str = "ts", late: str = "1 minute", **config: float) -> DataFrame:
    """Evidence (ts, start, end, kind, weight) of a stream to spans; what silence ends counts as an idle gap."""
    idle = Hypotheses(**config).idle

    def finish(machine: Hypotheses) -> list[dict]:
        return [x | {"reason": "idleGap"} for x in machine.finish(max((h["last"] for h in machine.active), default=0.0))]

    return _stateful(evidence, keys, at, late, ["start", "end", "kind", "weight"], f"{key_types}, {HYPOTHESIS}", lambda kept: Hypotheses(**(json.loads(kept) if kept else config)), lambda m, row: m.take(float(row[0]), float(row[1]), row[2], float(row[3])), finish, int(idle * 1000))
