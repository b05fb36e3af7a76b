"""Slots against the plain rules on random spans."""

import random

from spanloom.operators import slots as sl


def test_gate(spark):
    rows = [(1, 1, "a", "a", 0.5), (2, 1, "a", "a", 0.9), (1, 1, "a", "b", 0.9), (1, 1, "a", "a", 0.49), (None, None, "a", "a", 0.9), (1, 1, "a", "a", None)]
    frame = spark.createDataFrame(rows, "stored_version int, version int, stored_identity string, identity string, fraction double")
    assert [r.outcome for r in sl.gate(frame).collect()] == ["accepted", "staleVersion", "audioIdentityMismatch", "lowAlignedFraction", "staleVersion", "lowAlignedFraction"]


def test_fragments(spark):
    rows = [("a", 0.0, 10.0, 1.0, 2.0), ("a", 13.0, 20.0, 3.0, 4.0), ("a", 12.0, 30.0, 5.0, 6.0), ("a", 33.5, 40.0, 7.0, 8.0), ("a", 100.0, 600.0, 0.0, 0.0), ("b", 0.0, 480.0, 9.0, 9.0)]
    got = sl.merged(spark.createDataFrame(rows, "k string, start double, end double, left double, right double"), ["k"]).collect()
    assert {tuple(r) for r in got} == {("a", 0.0, 30.0, 1.0, 4.0), ("a", 33.5, 40.0, 7.0, 8.0), ("b", 0.0, 480.0, 9.0, 9.0)}


def touch(a, b):
    return a[0] < b[1] and b[0] < a[1]


def plain_owner(core, slots, vetoes):
    if core[1] <= core[0]:
        return None, "degenerateCore"
    met = sorted((-(min(core[1], s[1]) - max(core[0], s[0])), *s) for s in slots if touch(core, s))
    if not met:
        return None, "noCandidatePairs"
    shared, start, end = -met[0][0], *met[0][1:3]
    if shared / (core[1] - core[0]) < 0.8 and not (start >= core[0] and end <= core[1] and len(met) == 1):
        return (start, end), "coreCoverageBelowMinimum"
    if any(touch((start, end), v) and not touch(core, v) for v in vetoes):
        return (start, end), "vetoNewlyEnclosed"
    return (start, end), None


def plain_pair(core, breaks, vetoes):
    if core[1] <= core[0]:
        return None, "degenerateCore"
    starts = [b for b in breaks if core[0] - 120 <= b[0] <= core[0] + 8]
    ends = [b for b in breaks if core[1] - 8 <= b[0] <= core[1] + 120]
    pairs = [(x, y, min(core[1], y[0]) - max(core[0], x[0])) for x in starts for y in ends if x[0] < y[0] and min(core[1], y[0]) > max(core[0], x[0])]
    fit = sorted((y[0] - x[0] - n, -min(x[1], y[1]), x[0], y[0], n) for x, y, n in pairs if 5 <= y[0] - x[0] <= 180)
    if not fit:
        return None, "durationOutOfRange" if pairs else "noCandidatePairs"
    best = fit[0]
    for p in fit[1:]:
        if -p[1] >= 1.5 * -best[1]:
            best = p
    slot = best[2:4]
    if -best[1] < 0.15:
        return slot, "edgeBelowFloor"
    if best[4] / (core[1] - core[0]) < 0.8:
        return slot, "coreCoverageBelowMinimum"
    if any(touch(slot, v) and not touch(core, v) for v in vetoes):
        return slot, "vetoNewlyEnclosed"
    return slot, None


def test_owners_and_pairs(spark):
    rng = random.Random(9)
    cores, slots, breaks, vetoes, owners, pairs = [], [], [], [], {}, {}
    for k in range(150):
        span = lambda most: (a := float(rng.randrange(400)), a + rng.randrange(most))
        own_slots = sorted({span(200) for _ in range(rng.randrange(6))})
        own_slots = [s for i, s in enumerate(own_slots) if s[1] > s[0] and all(s[0] >= e for _, e in own_slots[:i])]
        own_breaks = {float(rng.randrange(500)): rng.choice([0.1, 0.2, 0.3, 0.5, 0.9]) for _ in range(rng.randrange(14))}
        own_vetoes = [span(20) for _ in range(rng.randrange(3))]
        core = span(90)
        cores.append((k, k, *core))
        slots += [(k, *s, 30.0, 90.0) for s in own_slots]
        breaks += [(k, *b) for b in own_breaks.items()]
        vetoes += [(k, *v) for v in own_vetoes]
        proper = [v for v in own_vetoes if v[1] > v[0]]
        owners[k] = plain_owner(core, own_slots, proper)
        pairs[k] = plain_pair(core, list(own_breaks.items()), proper)
    frame = lambda rows, columns: spark.createDataFrame(rows, f"k int, {columns}")
    spans, vetoed = frame(cores, "id int, start double, end double"), frame(vetoes, "start double, end double")
    got = sl.owned(spans, frame(slots, "start double, end double, left double, right double"), vetoed, ["k"], bucket=64).collect()
    assert {r.k: (None if r.slot_start is None else (r.slot_start, r.slot_end), r.reason) for r in got} == owners and len(got) == 150
    got = sl.resolved(spans, frame([*breaks, (0, None, 0.5)], "at double, score double"), vetoed, ["k"], bucket=64).collect()
    assert {r.k: (None if r.slot_start is None else (r.slot_start, r.slot_end), r.reason) for r in got} == pairs and len(got) == 150
    assert len({r for _, r in owners.values()}) >= 4 and len({r for _, r in pairs.values()}) >= 5
