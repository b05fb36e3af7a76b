"""Signatures and alignments against plain versions."""

import random

from pyspark.sql import functions as F

from spanloom.functions import fingerprints as fp

MASK = 2**64 - 1


def fnv(text):
    h = fp.FNV_OFFSET
    for byte in text.encode():
        h = (h ^ byte) * fp.FNV_PRIME & MASK
    return h


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_hashes(spark):
    texts = ["a", "", None, "ein längerer Text", "漢字"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fp.stable_hash(F.col("t")).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: signed(fnv(t)) if t else None for i, t in enumerate(texts)}
    grams = [["abcd", "bcdé", "x"], [], None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(grams)], "i int, g array<string>").select("i", fp.minhash(F.col("g")).alias("s"))
    rows = rows.withColumn("back", fp.decode_signature(fp.encode_signature(F.col("s"))))
    for r in rows.collect():
        g = grams[r.i]
        want = None if g is None else [signed(min((((fnv(x) + i * fp.STEP_A) & MASK) ^ (i * fp.STEP_B & MASK) for x in g), default=MASK)) for i in range(128)]
        assert r.s == want and (want is None or r.back == want)


def test_simhash(spark):
    rng = random.Random(fp.WEIGHT_SEED)
    weights = [[1 if rng.random() >= 0.5 else -1 for _ in range(64)] for _ in range(32)]
    frames = [random.Random(i).sample(range(2**32), 5) for i in range(4)]
    for r in spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "i int, f array<long>").select("i", fp.simhash(F.col("f")).alias("b")).collect():
        votes = [sum((1 if f >> i & 1 else -1) * weights[i][b] for f in frames[r.i] for i in range(32)) for b in range(64)]
        assert r.b == signed(sum(1 << b for b in range(64) if votes[b] > 0))


def test_alignment(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcde") for _ in range(rng.randrange(12))], [rng.choice("abcde") for _ in range(rng.randrange(12))]) for _ in range(40)]

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        return max(map(max, table)) / (2 * min(len(a), len(b))) if a and b else 0.0

    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    assert {r.i: r.s for r in frame.select("i", fp.alignment(F.col("a"), F.col("b")).alias("s")).collect()} == {i: plain(a, b) for i, (a, b) in enumerate(pairs)}


def test_differences(spark):
    frames = lambda seed, n: [random.Random(seed).randrange(2**32) for _ in range(1)] + [random.Random(seed * 1000 + i).randrange(2**32) for i in range(n - 1)]
    show, old, new = frames(1, 60), frames(2, 20), frames(3, 30)
    noisy = [x ^ 1 for x in show]
    cases = [(show[:25] + old + show[25:], show[:25] + new + show[25:]), (show[:25] + old + show[25:], noisy), (show, show), (show, []), ([], new)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<long>, b array<long>")
    got = {r.i: [tuple(s) for s in r.s] for r in frame.select("i", fp.differences(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[0] == [("a", 25, 45, 25, 35), ("b", 25, 55, 25, 35)]
    assert got[2] == [] and got[3] == [("a", 0, 60, 0, 0)] and got[4] == [("b", 0, 30, 0, 0)]
    # seeds need an equal frame, so a copy in which every frame differs by a bit is not found
    assert got[1] == [("a", 0, 80, 0, 0), ("b", 0, 60, 0, 0)]


def test_nulls_within_arrays(spark):
    rows = spark.createDataFrame([(["a", None, "b"], [1, None, 2], [1, 2, 3]), (["a", "b"], [1, 2], [1, None]), (None, None, None), ([], [], []), ([None], [None], [1])], "t array<string>, f array<long>, g array<long>")
    got = rows.select(fp.minhash(F.col("t")).alias("m"), fp.simhash(F.col("f")).alias("s"), fp.differences(F.col("f"), F.col("g")).alias("d")).collect()
    assert got[0].m == got[1].m and got[3].m == got[4].m and got[2].m is None
    assert got[0].s == got[1].s and got[3].s == got[4].s and got[2].s is None
    assert [r.d is None for r in got] == [True, True, False, False, True]
