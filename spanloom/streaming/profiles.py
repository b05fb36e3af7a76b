"""Profiles on streams: rows are held until the watermark has passed them and then taken in order, so the order of batches does not matter."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Ordered(StatefulProcessor):
    """Rows of a key in a list until a timer at their time fires; the machine's fields as one value."""

    def __init__(self, machine: type, config: dict, order: int, held: str, names: list[str]) -> None:
        self.machine, self.config, self.order, self.held, self.names = machine, config, order, held, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.state = handle.getValueState("machine", "fields string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for frame in rows:
            own = [c for c in frame.columns if c.startswith(("event_ms", "order_", "column_"))]
            lines = [tuple(None if pd.isna(x) else x for x in row) for row in frame[own].itertuples(index=False, name=None)]
            for at in {int(r[0]) for r in lines}:
                self.handle.registerTimer(at)
            if lines:
                self.rows.appendList([(json.dumps(list(map(_plain, r))),) for r in lines])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        every = [json.loads(r[0]) for r in self.rows.get()] if self.rows.exists() else []
        ready = sorted((r for r in every if r[0] <= until), key=lambda r: r[: self.order + 1])
        if not ready:
            return
        later = [(json.dumps(r),) for r in every if r[0] > until]
        if later:
            self.rows.put(later)
        else:
            self.rows.clear()
        m = self.machine(**(json.loads(self.state.get()[0]) if self.state.exists() else self.config))
        found = [(*key, *r[1 : self.order + 1], *m.take(*r[self.order + 1 :])) for r in ready]
        self.state.update((json.dumps(dataclasses.asdict(m)),))
        yield pd.DataFrame(found, columns=self.names).astype(object)


def _plain(x: object) -> object:
    return x.item() if hasattr(x, "item") else x


def histories(events: DataFrame, keys: Sequence[str], key_types: str, order: Sequence[str], order_types: str, machine: type, at: str = "ts", late: str = "1 hour", **config: float) -> DataFrame:
    """As ``operators.profiles.histories``, on a stream with event time ``at`` (rows of equal time follow ``order``).

    A profile moves on when the watermark has passed a row; rows that come later than ``late`` are dropped. Needs the RocksDB state store.
    """
    names = [f.split()[0] for f in f"{key_types}, {order_types}, {machine.SCHEMA}".split(", ")]
    there = events.dropna(subset=[*keys, *order, at]).withWatermark(at, late)
    rows = there.select(*keys, F.unix_millis(at).alias("event_ms"), *(F.col(c).alias(f"order_{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"column_{i}") for i, c in enumerate(machine.COLUMNS)), F.col(at).alias("event_at"))
    processor = _Ordered(machine, config, len(order), "line string", names)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, f"{key_types}, {order_types}, {machine.SCHEMA}", "Append", "EventTime")
