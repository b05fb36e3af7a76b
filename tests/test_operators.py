"""Operators on small frames: hand-worked cases, and brute force where SQL has no place."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scores as sc
from spanloom.functions import text as tx
from spanloom.operators import evaluate as ev
from spanloom.operators import graph as gr
from spanloom.operators import intervals as iv
from spanloom.operators import rollups as ru
from spanloom.operators import scoring
from spanloom.operators import segments as sg
from spanloom.operators import stores as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine_pads_the_shorter_vector(spark):
    vector = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, tx.cosine(vector(1.0, 1.0), vector(1.0, 1.0, 0.0))) == pytest.approx(1.0)
    assert one(spark, tx.cosine(vector(1.0, 0.0), vector(-1.0, 0.0))) == 0.0
    assert one(spark, tx.cosine(vector(0.0, 0.0), vector(1.0, 0.0))) == 0.0


def test_addresses(spark):
    canonical = lambda u: one(spark, tx.canonical_url(F.lit(u)))
    assert canonical("https://A.com:8080/x/?utm_source=q&b=1#f") == "https://a.com:8080/x?b=1#f"
    assert canonical("http://a.com:80/x") == "http://a.com/x"
    assert canonical("a.com/x/?ref=1") == "a.com/x"
    assert canonical("https://a.com/") == "https://a.com/"
    assert one(spark, tx.domain(F.lit("x.y.co.uk/p"))) == "y.co.uk"
    assert one(spark, tx.domain(F.lit("http://10.0.0.1/p"))) is None
    assert one(spark, tx.domains_in(F.lit("see www.shop.example.com/a, or https://b.co.uk/x and no.thing"))) == ["example.com", "b.co.uk"]


def test_entities(spark):
    assert one(spark, tx.strip_html(F.lit("<p>a&#39;b &amp;lt; &#233;&#x1F600; &mdash;<br>&#55296;</p>"))) == "a'b &lt; é😀 — &#55296;"


def test_hit_groups_count_promoting_hits_only(spark):
    hits = lambda *rows: spark.createDataFrame(rows, "k string, start long, end long, weight double")
    group = lambda *rows: [tuple(r)[1:] for r in scoring.hit_groups(hits(*rows), ["k"], gap=30).collect()]
    assert group(("a", 0, 1, -0.5), ("a", 5, 6, -0.5)) == []
    assert group(("a", 0, 1, 1.0), ("a", 20, 21, 1.0)) == [(0, 21, 2, 0.375)]
    assert group(("a", 0, 1, 1.0), ("a", 20, 21, 1.0), ("a", 51, 52, -1.0), ("a", 52, 53, -1.0)) == [(0, 21, 2, round(1 - 1 / 1.3, 6))]
    assert group(("a", 0, 1, 0.8)) == [] and group(("a", 0, 1, 0.95)) == [(0, 1, 1, round(1 - 1 / 1.285, 6))]


def test_open_ends_join(spark):
    a = spark.createDataFrame([("k", 5, 6), ("k", 10**12, 10**12 + 1)], "k string, start long, end long")
    b = spark.createDataFrame([("k", 0, 1 << 62)], "k string, start long, end long")
    assert iv.overlap_join(a, b, ["k"], bucket=10).count() == 2


def test_version_hash(spark):
    texts = ["ab", "cdé", ""]
    framed = b"".join(len(t.encode()).to_bytes(4, "big") + t.encode() for t in texts)
    assert one(spark, sc.version_hash(F.array(*map(F.lit, texts)))) == hashlib.sha256(framed).digest()[:16].hex()


def test_numbered_people(spark):
    rows = spark.createDataFrame([(1, "a@x.y wrote b@x.y and A@x.y"), (2, "none")], "id long, text string")
    got = {r.id: r.out for r in tx.numbered(rows, "text", "(?i)[a-z]@x[.]y", "P", "out").collect()}
    assert got == {1: "[P_A] wrote [P_B] and [P_A]", 2: "none"}


def test_clusters(spark):
    rng = random.Random(3)
    values = [(k, round(rng.random(), 2), 1) for k in "ab" for _ in range(60)]
    expected = []
    for k in "ab":
        found = []
        for x in sorted({v for q, v, _ in values if q == k}):
            w = sum(1 for q, v, _ in values if q == k and v == x)
            i = next((i for i, (c, _) in enumerate(found) if abs(c - x) <= 0.05), None)
            if i is None:
                found.append((x, w))
            else:
                c, n = found[i]
                found[i] = ((c * n + x * w) / (n + w), n + w)
        expected += [(k, round(c, 9), w) for c, w in found]
    got = ru.clusters(spark.createDataFrame(values, "k string, x double, w int"), ["k"], "x", "w", 0.05).collect()
    assert sorted((r.k, round(r.centroid, 9), int(r.weight)) for r in got) == sorted(expected)


def test_lifecycle(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.random() < 0.3 + 0.1 * k) for k in range(6) for i in range(90)]
    expected = {}
    for k in range(6):
        state, c, r = "candidate", 0, 0
        for _, _, good in [x for x in rows if x[0] == k]:
            c, r = c + good, r + (not good)
            for _ in range(5):
                rate = r / (c + r)
                state = {"candidate": "quarantined" if c >= 1 else state, "quarantined": "active" if c >= 2 and rate <= 0.3 else state, "active": "decayed" if rate > 0.5 else state, "decayed": "active" if c >= 2 and rate <= 0.3 else state}[state]
        expected[k] = (c, r, state)
    got = st.lifecycle(spark.createDataFrame(rows, "k int, i int, good boolean"), ["k"], ["i"], F.col("good"), ~F.col("good"), chunk=16).collect()
    assert {r.k: (r.confirmed, r.rolled, r.state) for r in got} == expected


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)] + [(None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = gr.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(parent)}


def _best(pairs):
    """Most pairs, then least cost, over all matchings."""
    best = (0, 0)

    def walk(left, used_t, n, cost):
        nonlocal best
        best = max(best, (n, -cost))
        for i, (p, t, c) in enumerate(left):
            if t not in used_t:
                walk([x for x in left[i + 1 :] if x[0] != p], used_t | {t}, n + 1, cost + c)

    walk(pairs, frozenset(), 0, 0)
    return best[0], -best[1]


def test_match_optimal(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for k in range(6):
        pairs = [(10 * k + p, 10 * k + t, rng.randrange(50)) for p in range(4) for t in range(4) if rng.random() < 0.6]
        rows += [(k, *x) for x in pairs]
        expected[k] = _best(pairs)
    got = {}
    for r in ev.match_optimal(spark.createDataFrame(rows, "k int, p long, t long, cost long"), ["k"]).collect():
        n, c = got.get(r.k, (0, 0))
        got[r.k] = (n + 1, c + r.cost)
    assert got == {k: v for k, v in expected.items() if v[0]}


def test_match_pairs(spark):
    rng = random.Random(13)
    rows = [("k", p, t, round(rng.random(), 2)) for p in range(12) for t in range(12) if rng.random() < 0.4]
    used_p, used_t, expected = set(), set(), set()
    for _, p, t, iou in sorted(rows, key=lambda r: (-r[3], r[2], r[1])):
        if p not in used_p and t not in used_t:
            used_p.add(p), used_t.add(t), expected.add((p, t))
    assert {(r.p, r.t) for r in ev.match_pairs(spark.createDataFrame(rows, "k string, p long, t long, iou double"), ["k"]).collect()} == expected


def test_platt_fit(spark):
    rng = random.Random(17)
    rows = [(x := round(rng.random(), 2), rng.random() < 1 / (1 + math.exp(-6 * x + 3))) for _ in range(400)]
    fit = ev.platt_fit(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).first()
    n1 = sum(y for _, y in rows)
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (len(rows) - n1 + 2)

    def loss(a, b):
        out = 0.0
        for x, y in rows:
            z, t = a * x + b, hi if y else lo
            out += t * z + math.log1p(math.exp(-z)) if z >= 0 else (t - 1) * z + math.log1p(math.exp(z))
        return out

    least = loss(fit.a, fit.b)
    assert fit.a < -3 and all(loss(fit.a + da, fit.b + db) >= least - 1e-6 for da, db in itertools.product((-0.05, 0, 0.05), repeat=2))
    assert ev.platt_fit(spark.createDataFrame([(0.1, True)], "s double, y boolean"), "s", F.col("y")).collect() == []


def _segments(spark, *windows, **config):
    frame = spark.createDataFrame([("k", float(s), float(e), float(x)) for s, e, x in windows], "k string, start double, end double, score double")
    return [(r.start, r.end, round(r.score, 6), r.n, r.promoted) for r in sorted(sg.hysteresis_segments(frame, ["k"], "k string", **config).collect(), key=lambda r: r.start)]


def test_hysteresis(spark):
    # one high window opens, fair ones keep it, a lull of three seconds closes it
    assert _segments(spark, (0, 20, 0.7), (20, 40, 0.3), (40, 41, 0.1), (41, 43, 0.1), (43, 60, 0.3)) == [(0, 40, 0.5, 2, True)]
    # two nearby candidates open; what lies between and is fair belongs to the segment
    assert _segments(spark, (0, 10, 0.4), (10, 20, 0.3), (20, 40, 0.5)) == [(0, 40, round((4 + 3 + 10) / 40, 6), 3, True)]
    # a single candidate opens nothing, and one beyond the reach neither
    assert _segments(spark, (0, 10, 0.4)) == [] and _segments(spark, (0, 10, 0.4), (200, 210, 0.4)) == []
    # a short dip that a later window reaches over counts; a gap beyond five seconds ends the segment
    assert _segments(spark, (0, 10, 0.8), (10, 12, 0.1), (12, 30, 0.5), (40, 80, 0.9)) == [(0, 30, round((8 + 0.2 + 9) / 30, 6), 3, True), (40, 80, 0.9, 1, True)]


def test_hypotheses(spark):
    def spans(*rows):
        frame = spark.createDataFrame([("k", float(s), float(e), kind, float(w)) for s, e, kind, w in rows], "k string, start double, end double, kind string, weight double")
        return [(r.start, r.end, r.n, r.confirmed, r.reason) for r in sorted(sg.hypotheses(frame, ["k"], "k string").collect(), key=lambda r: r.start)]

    assert spans((0, 1, "sponsor", 1), (5, 6, "body", 1), (8, 9, "body", 1), (10, 11, "return", 0.5)) == [(0, 11, 4, True, "returnMarker")]
    assert spans((0, 1, "sponsor", 1), (30, 31, "disclosure", 1)) == [(0, 1, 1, False, "idleGap"), (30, 31, 1, False, "timeout")]
    assert spans((0, 1, "body", 1), (2, 3, "return", 1)) == []
    assert spans((0, 1, "sponsor", 1), (3, 4, "url", 0.95)) == [(0, 4, 2, False, "explicitClose")]


def test_finalize(spark):
    def final(*rows, chapters=(), duration=10_000.0):
        spans = spark.createDataFrame([("k", i, float(s), float(e), float(c), "paid", "thirdParty") for i, s, e, c in rows], "k string, id string, start double, end double, confidence double, intent string, ownership string")
        marks = spark.createDataFrame([("k", float(s), float(e)) for s, e in chapters], "k string, start double, end double")
        length = spark.createDataFrame([("k", duration)], "k string, duration double")
        return [(r.id, r.start, r.end, r.gate) for r in sorted(sg.finalize(spans, marks, length, ["k"], "k string", bucket=300).collect(), key=lambda r: r.start)]

    assert final(("a", 0, 30, 0.9), ("b", 20, 60, 0.5), ("c", 70, 72, 0.9)) == [("a", 0, 60, "markOnly")]  # trimmed, then closer than three seconds
    assert final(("a", 0, 30, 0.9), ("b", 33, 60, 0.5)) == [("a", 0, 30, "eligible"), ("b", 33, 60, "eligible")]
    assert final(("a", 0, 400, 0.9)) == [("a#split-0", 0, 180, "markOnly"), ("a#split-1", 180, 360, "markOnly"), ("a", 360, 400, "markOnly")]
    assert final(("a", 0, 183, 0.9)) == [("a", 0, 183, "markOnly")]
    assert final(("a", 0, 30, 0.9), chapters=[(29, 50)]) == [("a", 0, 30, "markOnly")]
    assert final(("a", 0, 60, 0.9), ("b", 100, 160, 0.6), ("c", 200, 260, 0.6), duration=200.0) == [("a", 0, 60, "eligible"), ("b", 100, 160, "blockedByPolicy"), ("c", 200, 260, "blockedByPolicy")]


def test_quality_of_speech(spark):
    rows = spark.createDataFrame([(1, "one two"), (2, " ".join(["again and"] * 20) + "."), (3, None)], "id long, text string")
    got = {r.id: r for r in tx.speech_quality(rows, "text", F.lit(4.0)).collect()}
    assert (got[1].punctuation, got[1].repetition, got[1].word_length) == (0.5, 0.8, 0.5)
    assert got[2].repetition == 0.0 and got[2].density == 0.0


def test_hamming_pairs_of_a_crowded_bucket(spark, monkeypatch):
    """A bucket of more values than a cell holds is dealt to several; pairs that share several bands come once."""
    from spanloom.operators import joins

    monkeypatch.setattr(joins, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    values = [(i, sum(rng.randrange(4) << 8 * b for b in range(7)) - (rng.randrange(2) << 63)) for i in range(120)]
    first = {}
    for i, v in values:
        first.setdefault(v, i)
    part = lambda v, b: v >> 8 * b & 255
    expected = sorted((min(i, j), max(i, j), ((v ^ w) & (1 << 64) - 1).bit_count()) for v, i in first.items() for w, j in first.items() if i < j and any(part(v, b) == part(w, b) for b in range(8)) and ((v ^ w) & (1 << 64) - 1).bit_count() <= 6)
    got = joins.hamming_pairs(spark.createDataFrame(values, "id long, bits long"), "id", "bits", bands=8, most=6)
    assert sorted(tuple(r) for r in got.collect()) == expected and expected


def test_speech_quality_holds_no_batch_of_words():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "", *(" ".join(f"w{i % 50}x{j % 997}" for j in range(2000)) for i in range(400)), "one two three"])
    seconds = pa.array([60.0] * len(texts))
    tracemalloc.start()
    whole = tx._speech_parts(texts, seconds).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # 800,000 words would be over 50 MB as strings alone
    assert whole == [tx._speech_parts(texts[i : i + 1], seconds[i : i + 1]).to_pylist()[0] for i in range(len(texts))]
