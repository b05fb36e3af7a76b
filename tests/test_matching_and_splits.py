"""Greedy matching and cuts of long spans, to the end of the work."""

import random

import pytest

from spanloom.operators import evaluate as ev
from spanloom.operators import segments as sg

PAIRS = "k string, p long, t long, iou double"
ATOMS = "k string, ordinal long, start double, end double, anchored boolean, vetoed boolean, is_break boolean"


def greedy(rows):
    used, out = set(), set()
    for k, p, t, iou in sorted(rows, key=lambda r: (r[0], -r[3], r[2], r[1])):
        if ("p", k, p) not in used and ("t", k, t) not in used:
            used |= {("p", k, p), ("t", k, t)}
            out.add((k, p, t, iou))
    return out


@pytest.mark.parametrize("at_once", [100_000, 5])
def test_keys_do_not_compete(spark, at_once):
    rng = random.Random(3)
    rows = [(k, p, t, round(rng.random(), 2)) for k in "abc" for p in range(8) for t in range(8) if rng.random() < 0.3]
    frame = spark.createDataFrame([*rows, rows[0], ("a", None, 1, 0.9), (None, 1, 1, 0.9)], PAIRS)
    assert {tuple(r) for r in ev.match_pairs(frame, ["k"], at_once).collect()} == greedy(rows)
    assert ev.match_pairs(frame.limit(0), ["k"]).count() == 0


def test_a_chain_of_falling_overlap(spark):
    n = 300
    rows = [("k", i, i + d, 1 - (2 * i + d) / 1000) for i in range(n) for d in (0, 1) if i + d < n]
    expected = greedy(rows)
    assert len(expected) == n
    assert {tuple(r) for r in ev.match_pairs(spark.createDataFrame(rows, PAIRS), ["k"]).collect()} == expected


def cut(atoms, longest):
    """Pieces by the rule itself: cut at the longest inner gap, the first of equal ones, or at the middle; keep what cannot be cut."""
    start, end = min(a[1] for a in atoms), max(a[2] for a in atoms)
    if end - start <= longest:
        return [(atoms[0][0], atoms[-1][0], start, end)]
    gaps, run = [], []
    for i, a in enumerate(atoms):
        if a[3]:
            run.append(i)
        elif run:
            gaps.append(run)
            run = []
    gaps = [g for g in gaps if g[0] > 0]
    middle = (atoms[0][0] + atoms[-1][0]) // 2
    longest_gap = max(gaps, key=lambda g: (len(g), -g[0]), default=None)
    lost = {atoms[i][0] for i in longest_gap} if longest_gap else {middle}
    left, right = [a for a in atoms if a[0] < min(lost)], [a for a in atoms if a[0] > max(lost)]
    if not left and not right:
        return [(atoms[0][0], atoms[-1][0], start, end)]
    return [x for part in (left, right) if part for x in cut(part, longest)]


def split(spark, spans, longest):
    rows, found = [], []
    for key, atoms in spans:
        rows += [(key, o, s, e, not loose, False, False) for o, s, e, loose in atoms]
        found.append((key, atoms[0][0], atoms[-1][0], min(a[1] for a in atoms), max(a[2] for a in atoms)))
    frame = spark.createDataFrame(found, "k string, first long, last long, start double, end double")
    got = sg.split_long(frame, spark.createDataFrame(rows, ATOMS), ["k"], longest).collect()
    expected = sorted((key, *x) for key, atoms in spans for x in cut(atoms, longest))
    assert sorted(map(tuple, got)) == expected
    return expected


def test_no_span_is_lost(spark):
    every_other = [(i, i * 10.0, i * 10.0 + 10, i % 2 == 1) for i in range(199)]
    assert len(split(spark, [("a", every_other)], 30.0)) > 30
    assert split(spark, [("a", [(0, 0.0, 400.0, False)])], 180.0) == [("a", 0, 0, 0.0, 400.0)]


def test_random_spans(spark):
    rng = random.Random(8)
    spans = []
    for k in range(60):
        at, ordinal = 0.0, rng.randrange(5)
        for _ in range(rng.randrange(1, 3)):  # spans of a key, with atoms of none between
            atoms = []
            for i in range(n := rng.randrange(1, 40)):
                length = float(rng.choice([1, 5, 20, 90]))
                atoms.append((ordinal, at, at + length, 0 < i < n - 1 and rng.random() < 0.4))
                at, ordinal = at + length, ordinal + 1
            spans.append((f"k{k}", atoms))
            ordinal += 3
    split(spark, spans, 60.0)


def test_nulls_in_machines(spark):
    windows = [("a", float(i), i + 1.0, 0.9) for i in range(40)] + [("a", 5.0, 6.0, None), ("a", None, 6.0, 0.1), (None, 5.0, 6.0, 0.1)]
    schema = "k string, start double, end double, score double"
    plain = sg.hysteresis_segments(spark.createDataFrame(windows[:40], schema), ["k"], "k string").collect()
    assert sg.hysteresis_segments(spark.createDataFrame(windows, schema), ["k"], "k string").collect() == plain
    assert len(plain) == 1
    evidence = [("a", 0.0, 1.0, "sponsor", 3.0), ("a", 2.0, 3.0, "weather", 3.0), ("a", 4.0, 5.0, None, 1.0), ("a", None, 5.0, "url", 1.0), ("a", 4.0, 5.0, "url", None)]
    found = sg.hypotheses(spark.createDataFrame(evidence, "k string, start double, end double, kind string, weight double"), ["k"], "k string").collect()
    assert [(r.start, r.end, r.n) for r in found] == [(0.0, 1.0, 1)]


def test_optimal_matching_does_not_depend_on_order(spark):
    from spanloom.operators import evaluate as ev

    rows = [("k", p, t, 5) for g in range(20) for p in (3 * g, 3 * g + 1) for t in (3 * g, 3 * g + 1, 3 * g + 2)]
    found = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "k string, p long, t long, cost long")
        found.append(sorted((r.p, r.t) for r in ev.match_optimal(frame, ["k"]).collect()))
    assert found[0] == found[1] and len(found[0]) == 40
