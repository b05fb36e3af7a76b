"""Byte alignment against the plain procedure on whole files: unique frames, extension byte by byte, heaviest chain."""

import random
from collections import Counter

from spanloom.operators import align
from spanloom.sources import frames

HEADER = bytes.fromhex("fffb9064")


def frame(rng, fill=None):
    return HEADER + (bytes([fill]) * 413 if fill is not None else bytes(rng.randrange(0xF0) for _ in range(413)))


def walk(raw):
    return [(o, n) for o, n, is_frame, _, _ in frames.tiles(raw) if is_frame]


def plain_runs(a, b, least):
    fa, fb = walk(a), walk(b)
    ca, cb = Counter(a[o : o + n] for o, n in fa), Counter(b[o : o + n] for o, n in fb)
    at = {b[o : o + n]: o for o, n in fb}
    found = set()
    for o, n in fa:
        x = a[o : o + n]
        if ca[x] == 1 and cb[x] == 1:
            i, j, e, f = o, at[x], o + n, at[x] + n
            while e < len(a) and f < len(b) and a[e] == b[f]:
                e, f = e + 1, f + 1
            while i > 0 and j > 0 and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            if e - i >= least:
                found.add((i, j, e - i))
    return sorted(found)


def heaviest(runs):
    best = []
    for i, (a, b, n) in enumerate(runs):
        before = [best[j] for j in range(i) if runs[j][0] + runs[j][2] <= a and runs[j][1] + runs[j][2] <= b]
        best.append(max((x[0] for x in before), default=0) + n)
        chain = next((x[1] for x in before if x[0] + n == best[-1]), ())
        best[-1] = (best[-1], (*chain, (a, b, n)))
    return next((list(c) for w, c in best if w == max(x[0] for x in best)), [])


def pair(rng):
    """Two versions of a programme: parts in common, slots of each one's own, silence, tags and odd bytes."""
    a, b, cuts = [], [], []
    if rng.random() < 0.4:
        tag = b"ID3\x03\x00\x00\x00\x00\x00" + bytes([40]) + bytes(40)
        a.append(tag)
    for _ in range(rng.randrange(1, 5)):
        common = [frame(rng, 7 if rng.random() < 0.2 else None) for _ in range(rng.randrange(3, 12))]
        a += common
        b += common
        for side in (a, b):
            side += [frame(rng) for _ in range(rng.randrange(0, 6))]
        if rng.random() < 0.2:
            junk = bytes(rng.randrange(0xF0) for _ in range(rng.randrange(1, 60)))
            a.append(junk)
            b.append(junk)
        cuts.append(len(b"".join(a)))
    if rng.random() < 0.3:
        b.append(b"TAG" + bytes(125))
    return b"".join(a), b"".join(b)


def test_pairs(spark):
    rng = random.Random(5)
    streams = [(k, *pair(rng)) for k in range(100)]
    files = spark.createDataFrame(streams, "k int, a binary, b binary").repartition(4)
    a, b = (frames.read_tiles(files, ["k"], "k int", side).cache() for side in ("a", "b"))
    runs = align.runs(a, b, ["k"], least_bytes=900)
    got: dict = {}
    for r in align.chain(runs, ["k"], "k int").collect():
        got.setdefault(r.k, []).append((r.a_start, r.b_start, r.bytes, r.place))
    slots: dict = {}
    for r in align.slots(a, b, ["k"], "k int", least_bytes=900).collect():
        slots.setdefault(r.k, []).append((r.a_start, r.a_end, r.b_bytes, r.kind))
    aligned = 0
    for k, x, y in streams:
        expected = plain_runs(x, y, 900)
        assert sorted(r[:3] for r in got.get(k, [])) == expected, k
        chain = heaviest(expected)
        assert sorted(r[:3] for r in got.get(k, []) if r[3] is not None) == sorted(chain)
        lead = [frames.tag_length(z, 0) for z in (x, y)]
        ends = [(lead[0], lead[1], 0), *chain, (len(x), len(y), 0)] if chain else []
        gaps = [(p[0] + p[2], q[0], q[1] - p[1] - p[2]) for p, q in zip(ends, ends[1:])]
        assert sorted(s[:3] for s in slots.get(k, [])) == sorted(g for g in gaps if g[1] > g[0] or g[2] > 0)
        aligned += len(chain)
    assert aligned > 150


def test_times(spark):
    rng = random.Random(1)
    raw = b"ID3\x03\x00\x00\x00\x00\x00\x0a" + bytes(10) + frame(rng) + b"junk" + frame(rng) + frame(rng)[:100]
    tiles = frames.read_tiles(spark.createDataFrame([(1, raw)], "k int, content binary"), ["k"], "k int")
    assert [(t.offset, t.length, t.is_frame) for t in tiles.orderBy("offset").collect()] == [(0, 20, False), (20, 417, True), (437, 4, False), (441, 417, True), (858, 100, False)]
    points = spark.createDataFrame([(1, x) for x in (0, 20, 20 + 139, 440, 441 + 417, len(raw), len(raw) + 1)], "k int, byte long")
    second = 1152 / 44100
    got = {r.byte: round(r.second / second, 6) for r in align.times_at(points, tiles, ["k"]).collect()}
    assert got == {0: 0, 20: 0, 159: round(139 / 417, 6), 440: 1, 858: 2, len(raw): 2}


def test_empty_streams(spark):
    files = spark.createDataFrame([(1, None, b""), (2, b"no frames here", b"x"), (3, HEADER, None)], "k int, a binary, b binary")
    a, b = (frames.read_tiles(files, ["k"], "k int", side) for side in ("a", "b"))
    assert align.slots(a, b, ["k"], "k int").count() == 0
    assert [t[2] for t in frames.tiles(b"no frames here")] == [False]


def test_frame_lengths():
    # kbit/s and Hz of usual headers: MPEG 1 III, the same padded, MPEG 2 III, MPEG 1 II, MPEG 1 I, MPEG 2.5 III
    for header, length in (("fffb9064", 417), ("fffb9264", 418), ("fff38064", 208), ("fffd9064", 522), ("ffff9064", 312), ("ffe38064", 417)):
        raw = bytes.fromhex(header) + bytes(3000)
        import numpy as np

        places, lengths = frames.headers(np.frombuffer(raw, np.uint8))
        assert (places[0], lengths[0]) == (0, length), header


def test_only_tiles_at_points_are_sent_on(spark):
    from spanloom.operators import align as al

    side = spark.range(5000).selectExpr("id % 50 AS k", "id AS a_end", "CAST(id AS STRING) AS held")
    points = side.where("a_end % 1000 = 7").select("k", "a_end")
    got = [r.a_end for r in al._only(side, points, ["k"], "a_end").collect()]
    assert {7, 1007, 2007, 3007, 4007} <= set(got) and len(got) < 50 and len(got) == len(set(got))
    assert al._only(side, points.limit(0), ["k"], "a_end").count() == 0


def test_tiles_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rng = random.Random(3)
    files = spark.createDataFrame([(k, *pair(rng)) for k in range(4)], "k int, a binary, b binary")
    a, b = (frames.read_tiles(files, ["k"], "k int", side) for side in ("a", "b"))
    tiles = a.count() + b.count()
    assert align.slots(*(t.mapInArrow(counted, t.schema) for t in (a, b)), ["k"], "k int", least_bytes=900).count() > 0
    assert made.value == tiles


def test_tiles_of_many_files(spark):
    sizes = {1: 3, 2: frames.BATCH_TILES + 5, 3: 0, 4: 2}
    files = spark.createDataFrame([(k, (HEADER + bytes(413)) * n) for k, n in sizes.items()], "k int, content binary").coalesce(1)
    got: dict = {}
    for t in frames.read_tiles(files, ["k"], "k int").select("k", "offset", "length", "size").collect():
        got.setdefault(t.k, []).append(tuple(t)[1:])
    assert got == {k: [(417 * i, 417, 417 * n) for i in range(n)] for k, n in sizes.items() if n}


def test_streams_of_texts(spark, tmp_path):
    from spanloom.plans import alignment_queries

    texts = ["", "x" * 412, "y" * 413, "é" * 207, None, "z" * 2000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    framed = []
    for text in texts:
        raw = (text or "").encode()
        framed.append([HEADER + raw[i : i + 413].ljust(413, b"\0") for i in range(0, len(raw), 413)])
    for r in alignment_queries._versions(spark, str(tmp_path)).collect():
        own, half = framed[r.doc_id], len(framed[r.doc_id]) // 2
        for got, n in ((r.a, 1), (r.b, 2)):
            middle = framed[r.doc_id + n] if r.doc_id + n < len(framed) else []
            assert bytes(got) == b"".join([*own[:half], *middle, *own[half:]])
