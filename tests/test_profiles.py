"""Profiles by worked cases; streams out of order against the batch form; brackets against a plain machine."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spanloom.operators import brackets as br
from spanloom.operators import profiles as pr
from spanloom.streaming import profiles as st


def trust(*events, **start):
    m = pr.TrustMode(**start)
    for e in events:
        out = m.take(*e)
    return out


GOOD, FALSE, DECAY = ("good", 0.7, None), ("false", None, None), ("decay", None, None)


@pytest.mark.parametrize(
    ("events", "start", "expected"),
    [
        ([("good", 0.6, None)], {}, ("shadow", 20, 1, 0, 0)),
        ([("good", 0.92, None)], {}, ("manual", 50, 1, 0, 0)),
        ([("good", 0.919, None)], {}, ("shadow", 20, 1, 0, 0)),
        ([GOOD], {"mode": "shadow", "trust": 30, "observations": 2}, ("manual", 40, 3, 0, 0)),
        ([GOOD], {"mode": "shadow", "trust": 50, "observations": 1}, ("shadow", 60, 2, 0, 0)),
        ([GOOD], {"mode": "shadow", "trust": 29, "observations": 2}, ("shadow", 39, 3, 0, 0)),
        ([GOOD], {"mode": "manual", "trust": 65, "observations": 7}, ("manual", 75, 8, 0, 0)),
        ([GOOD], {"mode": "auto", "trust": 95, "observations": 20}, ("auto", 100, 21, 0, 0)),
        ([FALSE], {"mode": "auto", "trust": 80, "false_signals": 1}, ("manual", 70, 0, 2, 1)),
        ([FALSE], {"mode": "auto", "trust": 80}, ("auto", 70, 0, 1, 1)),
        ([FALSE], {"mode": "manual", "trust": 50, "false_signals": 3}, ("shadow", 40, 0, 4, 1)),
        ([FALSE], {"mode": "shadow", "trust": 5}, ("shadow", 0, 0, 1, 1)),
        ([DECAY], {"mode": "manual", "trust": 50, "false_signals": 5}, ("manual", 50, 0, 2, 0)),
        ([FALSE, DECAY], {}, (None, 0, 0, 0, 0)),
        ([("override", None, "auto"), FALSE, FALSE], {"mode": "shadow", "trust": 30}, ("manual", 10, 0, 2, 2)),
        ([("override", None, "manual")], {}, ("manual", 50, 0, 0, 0)),
        ([("override", None, "other"), ("weather", None, None), (None, None, None), ("good", None, None)], {}, (None, 0, 0, 0, 0)),
    ],
)
def test_trust(events, start, expected):
    assert trust(*events, **start) == expected


def test_device_profile():
    m = pr.DeviceProfile()
    day = 86_400.0
    for i in range(29):
        assert m.take(120.0, i * 60.0, 100.0)[-1] == "learning"
    assert m.take(120.0, 3000.0, 100.0)[4:] == (1.1, 0, "moved")
    assert m.take(120.0, 4000.0, 100.0)[-1] == "waiting"
    assert m.take(120.0, 3000.0 + day, 100.0)[4:] == (1.2, 0, "moved")
    assert m.take(float("nan"), 9e9, 100.0)[-1] == m.take(-1.0, 9e9, 100.0)[-1] == m.take(None, 9e9, 100.0)[-1] == "ignored"
    happened = [m.take(1000.0, 1e6 + i, 100.0) for i in range(12)]
    assert [h[-1] for h in happened].index("reverted") == 9 and happened[9][:6] == (0, 0.0, 0.0, 0.0, 1.0, 0)  # an average of 296 leaves the band at once


def test_jingles():
    m = pr.Jingles(near=1, evict=2, most=2)
    assert m.take(0b1000, None) == (1, 0, 1, False, False)
    assert m.take(0b1001, 0) == (1, 1, 0, True, False)  # one bit off, so known
    assert m.take(-1, 0b111000000) == (2, 1, 1, False, False)  # the first is forgotten
    assert m.take(0b1000, None) == (0, 0, 0, False, False)  # the second miss in a row
    assert m.take(-1, -1) == (1, 0, 1, False, False)


def test_capability(spark):
    rows = [("a", i < 4, False, True, False) for i in range(5)] + [("b", False, i < 7, None, True) for i in range(10)] + [("c", True, True, True, True)] * 4 + [("d", True, True, True, True)] * 5 + [("e", False, False, i < 5, i < 6) for i in range(10)]
    frame = spark.createDataFrame(rows, "k string, chapters boolean, host boolean, sponsor boolean, dynamic boolean")
    kinds = {r.k: r.kind for r in pr.capability(frame, ["k"], F.lit(False), F.max(F.col("k") != "d")).collect()}
    assert kinds == {"a": "chapterRich", "b": "hostReadOnly", "c": "unknown", "d": "unknown", "e": "sponsorDeclared"}
    assert {r.kind for r in pr.capability(frame.where("k = 'a'"), ["k"], F.lit(True), F.lit(True)).collect()} == {"musicBedReliable"}


def test_persistence(spark):
    passes = [(0, "storageFull"), (1000, "waitingForNetwork"), (1800, "storageFull"), (2000, None), (2100, "storageFull"), (9000, "storageFull"), (9100, "tripReady"), (9200, "storageFull")]
    frame = spark.createDataFrame([("a", *p) for p in passes], "k string, at long, candidate string")
    got = [r.verdict for r in pr.persistent(frame, ["k"], "at").orderBy("at").collect()]
    assert got == [None, None, "storageFull", None, None, "storageFull", "tripReady", None]
    children = [("a", 1, True, None, None), ("a", 1, True, "storageFull", True), ("a", 2, False, "waitingForNetwork", True), ("a", 2, False, "analysisUnavailable", False), ("a", 3, None, "storageFull", None)]
    found = pr.blockers(spark.createDataFrame(children, "k string, at long, ready boolean, reason string, fixable boolean"), ["k"], "at")
    assert {r["at"]: r.candidate for r in found.collect()} == {1: "tripReady", 2: "waitingForNetwork", 3: None}


def test_streams_take_rows_in_order(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(f"u{rng.randrange(3)}", start + timedelta(minutes=rng.randrange(600)), i, rng.choice(["good", "false", "decay", "override"]), rng.random(), rng.choice(["auto", "manual", None])) for i in range(200)]
    schema = "k string, ts timestamp, n long, event string, confidence double, mode string"
    frame = spark.createDataFrame(rows, schema).withColumn("at", F.unix_millis("ts"))
    batch = pr.histories(frame, ["k"], "k string", ["at", "n"], "at long, n long", pr.TrustMode)
    want = {tuple(r) for r in batch.collect()}
    rng.shuffle(rows)  # files of a stream are out of order, all within the lateness; the last row moves the watermark behind all
    for i in range(0, 200, 40):
        spark.createDataFrame(rows[i : i + 40], schema).withColumn("at", F.unix_millis("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", start + timedelta(days=9), 999, "decay", 0.0, None)], schema).withColumn("at", F.unix_millis("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = st.histories(stream, ["k"], "k string", ["at", "n"], "at long, n long", pr.TrustMode, late="2 days")
        query = found.writeStream.format("memory").queryName("trust").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
            got = [tuple(r) for r in spark.table("trust").collect()]
        finally:
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert len(got) == len(want) == 200 and set(got) == want


def plain(windows, start, end, config):
    """The scan as it reads, one window after the other, on (start, end, level, onset, offset, music)."""
    windows = sorted(windows)
    length = windows[1][0] - windows[0][0] if len(windows) > 1 else 2.0
    near = [w for w in windows if w[1] >= start - 5 * length and w[0] <= end + 5 * length]
    if len(near) < 3:
        return None
    state, on, off, bed, gap, out, trail = "idle", None, None, 0, 0, 0, []
    for s, e, level, onset, offset, music in near:
        if state == "idle":
            if onset >= config.onset and s <= start + length:
                state, on, gap = "onset", (s, level, onset), 0
        elif state == "onset":
            gap += 1
            if music >= config.bed:
                state, bed, out = "bed", 1, 0
            elif gap > config.onset_gap:
                state, on = "idle", None
        elif state == "bed":
            if music >= config.bed:
                bed, out = bed + 1, 0
            else:
                out += 1
                if out >= config.dropouts:
                    state, on, bed, out = "idle", None, 0, 0
                    continue
            if offset >= config.offset and bed >= config.least_bed and s >= end - length:
                state, off = "offset", (e, offset)
        elif state == "offset":
            trail.append(level)
            if len(trail) >= config.fade_windows:
                state = "done"
    return on, off, min(bed, br.FULL_BED), trail


def test_brackets(spark):
    rng = random.Random(6)
    config = br.Bracket()
    windows, spans, expected = [], [], {}
    for k in range(120):
        own = [(2.0 * i, 2.0 * i + 2, round(rng.random(), 2), rng.choice([0.0, 0.1, 0.4]), rng.choice([0.0, 0.5]), rng.choice([0.0, 0.3, 0.9])) for i in range(rng.randrange(1, 60))]
        windows += [(k, *w) for w in own]
        start = 2.0 * rng.randrange(0, 40)
        spans.append((k, k + 1000, start, start + rng.randrange(1, 50), 0.5))
        found = plain(own, *spans[-1][2:4], config)
        if found and (found[0] or found[1]):
            expected[k] = found
    frame = spark.createDataFrame(windows, "k int, start double, end double, level double, onset double, offset double, music double")
    marked = spark.createDataFrame([*spans, (1, None, None, None, None)], "k int, id long, start double, end double, trust double")
    results = []
    for stretch in (7.0, 1e6):  # many stretches of a few windows, or one
        got = {r.k: r for r in br.brackets(frame, marked, ["k"], "k int", bucket=32, stretch=stretch).collect()}
        assert got.keys() == expected.keys() and len(got) > 40
        for k, (on, off, bed, _) in expected.items():
            span = spans[k]
            assert (got[k].onset, got[k].offset) == (on[0] if on else span[2], off[0] if off else span[3])
            score = (0.4 if on and off else 0.15) + 0.15 * min(on[2] if on else 0, 1) + 0.15 * min(off[1] if off else 0, 1) + 0.15 * bed / 5
            assert got[k].score == pytest.approx(score * 0.75)
            assert (got[k].template == "partialOnset") == (off is None) and (got[k].template == "partialOffset") == (on is None)
        results.append({k: (r.template, round(r.score, 9)) for k, r in got.items()})
    assert results[0] == results[1]
    assert len({t for t, _ in results[0].values()}) >= 4


def test_stretches_compose():
    rng = random.Random(2)
    config = br.Bracket(dropouts=3)
    rows = [(rng.randrange(8), float(i), i + 1.0, rng.random(), rng.random(), rng.random()) for i in range(300)]
    whole = br._stretch(rows, config)
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, 300), 4))
        parts = [br._stretch(rows[a:b], config) for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
        left = br.composed(br.composed(br.composed(br.composed(*parts[:2]), parts[2]), parts[3]), parts[4])
        right = br.composed(parts[0], br.composed(parts[1], br.composed(parts[2], br.composed(parts[3], parts[4]))))
        for i in (0, 1, 5, 8):
            assert list(left[i]) == list(right[i]) == list(whole[i])
        for touched, columns in ((1, (2, 3, 4)), (5, (6, 7))):
            for c in columns:
                assert [x for x, t in zip(left[c], left[touched]) if t == 1] == [x for x, t in zip(whole[c], whole[touched]) if t == 1]
