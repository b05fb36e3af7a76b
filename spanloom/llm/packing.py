"""Operator 5, mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. The output is a run of windows of ``window`` sequences;
in each window every queue has one turn and gives its quantum (its share of the window's tokens)
plus the deficit it carries: what the quanta so far, which need not be whole tokens, have left over.
A queue's quanta up to window k are thus ``floor(k * quantum)`` tokens, wherever its documents lie: knowing
how many tokens of the queue stand ahead of a document, its windows and places follow by arithmetic.
So deficits carry across windows and partitions without a scan in order. Target shares are by default
the sources' shares of all tokens; with given weights, an exhausted queue's share goes to the others.

Documents are cut at a turn's end and at a sequence's end. Every sequence but the last few is full, and
the remainder fills sequences whose lengths are powers of two: there is no padding.

Sources of at least ``1 / SHARES`` of all tokens, no more than ``SHARES`` then, have queues of their own; smaller ones,
which have less than a document in a window anyway, share one queue that takes their documents task by task. With given weights every source
has its own.

One scan tokenises and writes ids with the tokens ahead in their task and source; sums per task and
source (not per document) give each of these its place in its queue, by window sums on Spark, and are joined to the rows;
a second scan places the pieces. A source of any size is spread over all tasks.

Defined results: null or empty text is a document of the end id alone; a null source is a source;
repeated rows are packed each; an empty table gives no pieces; only doc_id, text and source are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.encoders import worker_encoder
from spanloom.llm.store import materialize

SHARES = 1000
SLICE_BYTES = 1 << 22


def tokenized(docs: DataFrame, vocabulary: str, keep_space: bool, end_id: int) -> DataFrame:
    """doc_id, source, n, ids (with the end id), task, and ``ahead``: the tokens of the source before it in its task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ahead: dict[str | None, int] = {}
        for batch in batches:
            encoder = worker_encoder(vocabulary, keep_space)
            end, size = np.array([end_id], encoder.dtype).tobytes(), int(encoder.dtype[2])
            _, offsets = tx.doc_bytes(batch.column(1))
            for i, j in tx.doc_slices(offsets, SLICE_BYTES):
                ids = [x + end for x in encoder.encode([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])]
                sources, before = batch.column(2).slice(i, j - i), []
                for source, x in zip(sources.to_pylist(), ids, strict=True):
                    before.append(ahead.get(source, 0))
                    ahead[source] = before[-1] + len(x) // size
                n = [len(x) // size for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sources, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * (j - i), pa.int64()), pa.array(before, pa.int64())], names=["doc_id", "source", "n", "ids", "task", "ahead"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")).mapInArrow(scan, "doc_id long, source string, n long, ids binary, task long, ahead long")


class Layout:
    """Where each queue's tokens go: cumulated quanta, windows, sequences."""

    def __init__(self, totals: list[int], weights: list[Fraction] | None, window: int, length: int):
        self.totals, self.window, self.length = totals, window, length
        self.n = sum(totals)
        weights = weights or [Fraction(t) for t in totals]
        if len(weights) != len(totals) or any(w <= 0 for w, t in zip(weights, totals, strict=True) if t):
            raise ValueError("each source with documents needs a positive weight")
        # phases: in each the queues that still have tokens share by weight; (tokens so far, per queue: given so far, rate)
        given, done = [Fraction(0)] * len(totals), Fraction(0)
        self.starts: list[Fraction] = []
        self.phases: list[tuple[list[Fraction], list[Fraction]]] = []
        while any(g < t for g, t in zip(given, totals, strict=True)):
            live = sum((w for w, g, t in zip(weights, given, totals, strict=True) if g < t), Fraction(0))
            rate = [w / live if g < t else Fraction(0) for w, g, t in zip(weights, given, totals, strict=True)]
            span = min((t - g) / r for g, t, r in zip(given, totals, rate, strict=True) if r)
            self.starts.append(done)
            self.phases.append((given, rate))
            given = [g + r * span for g, r in zip(given, rate, strict=True)]
            done += span
        self.windows = -(-self.n // window)
        self._at: dict[int, list[int]] = {}
        self.full = self.n // length * length
        self.ends = [self.full]  # ends of the short sequences behind the full ones
        rest = self.n - self.full
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.ends.append(self.ends[-1] + (1 << bit))

    def given(self, k: int) -> list[int]:
        """Tokens that each queue has given up to window k."""
        if k not in self._at:
            if k >= self.windows:
                return self.totals
            if len(self._at) > 4096:
                self._at.clear()
            done = k * self.window
            phase = bisect_right(self.starts, done) - 1
            base, rate = self.phases[phase]
            past = done - self.starts[phase]
            self._at[k] = [int(g + r * past) for g, r in zip(base, rate, strict=True)]
        return self._at[k]

    def given_by(self, k: int, queue: int) -> int:
        """Tokens that one queue has given up to window k."""
        if k >= self.windows:
            return self.totals[queue]
        done = k * self.window
        phase = bisect_right(self.starts, done) - 1
        base, rate = self.phases[phase]
        return int(base[queue] + rate[queue] * (done - self.starts[phase]))

    def pieces(self, queue: int, ahead: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of a document with ``ahead`` tokens of its queue before it."""
        lo, hi = 0, self.windows
        while hi - lo > 1:  # the last window that begins at or before it
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.given_by(mid, queue) <= ahead else (lo, mid)
        k, at = lo, 0
        while at < n:
            here, after = self.given(k), self.given(k + 1)
            take = min(n - at, after[queue] - (ahead + at))
            if take > 0:
                place = sum(here) + sum(a - b for a, b in zip(after[:queue], here[:queue], strict=True)) + ahead + at - here[queue]
                while take:
                    if place < self.full:
                        sequence, offset, room = place // self.length, place % self.length, self.length - place % self.length
                    else:
                        t = bisect_right(self.ends, place) - 1
                        sequence, offset, room = self.full // self.length + t, place - self.ends[t], self.ends[t + 1] - place
                    length = min(take, room)
                    yield at, length, sequence, offset
                    at, place, take = at + length, place + length, take - length
            k += 1


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = 2048, window: int = 64, weights: dict[str | None, float] | None = None, keep_space: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights``: target shares by source, in any unit; by default the sources' shares of all tokens.
    """
    table = materialize(tokenized(docs.select("doc_id", "text", "source"), vocabulary, keep_space, end_id), "tokens")
    sums = materialize(table.groupBy("source", "task").agg(F.sum("n").alias("n")), "sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    own = by_source if weights is not None else by_source.where(F.col("n") * SHARES >= total)
    most = SHARES if weights is None else len(weights)
    named = [(r["source"], r["n"]) for r in own.orderBy(F.col("source").asc_nulls_first()).limit(most + 1).collect()]
    if weights is not None and any(not weights.get(s) for s, _ in named):
        raise ValueError("each source with documents needs a positive weight")
    totals = [n for _, n in named]
    if sum(totals) < total:
        totals.append(total - sum(totals))  # the small sources together
    layout = Layout(totals, None if weights is None else [Fraction(weights[s]) for s, _ in named], window * length, length)
    queues = F.broadcast(docs.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate(named)], "name string, queue int"))  # SHARES rows at most
    placed = sums.join(queues, F.col("source").eqNullSafe(F.col("name")), "left").withColumn("queue", F.coalesce("queue", F.lit(len(named)))).drop("name")
    before = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("queue", "task").agg(F.sum("n").alias("n")).select("queue", "task", F.coalesce(F.sum("n").over(before("queue").orderBy("task")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(before("queue", "task").orderBy("source")), F.lit(0))
    starts = placed.withColumn("inside", inside).join(tasks, ["queue", "task"]).select(F.col("source").alias("of"), F.col("task").alias("in_task"), "queue", (F.col("first") + F.col("inside")).alias("begin"))
    starts = materialize(starts, "starts")  # a written table's size is known, so a small one is sent to the rows instead of moving these
    rows = table.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in_task"))).select("doc_id", "source", "n", "ids", (F.col("begin") + F.col("ahead")).alias("at"), "queue")
    shared = docs.sparkSession.sparkContext.broadcast(layout)  # some numbers for each of at most SHARES + 1 queues
    wide = worker_encoder(vocabulary, keep_space).dtype
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                for doc_id, source, n, raw, at, queue in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    ids = np.frombuffer(raw, wide).astype("<u4").tobytes()
                    for start, size, sequence, offset in plan.pieces(queue, at, n):
                        rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, offset, source))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    return rows.mapInArrow(place, ", ".join(f"{c} long" for c in names[:-1]) + ", source string")
