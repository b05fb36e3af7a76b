"""Substring dedup, centroid clusters and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import kmeans, periodic, substrings
from tests.llm import edge_cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


# substrings


def kept_words(docs, window):
    """(doc_id, text) -> (doc_id, words, removed, kept) of each."""
    least = {}
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for d, text in docs:
        w = words(text)
        gone = {i + k for i in range(len(w) - window + 1) if d is not None and least[tuple(w[i : i + window])] < d for k in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}" if rng.random() < 0.95 else rng.choice(["é漢😀", "\x01a", "x" * 300])
    shared = [[word() for _ in range(rng.randrange(5, 90))] for _ in range(6)]
    docs = []
    for d in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(1, 40))]
            if rng.random() < 0.1:
                w += ["again"] * rng.randrange(200)
        docs.append((d, rng.choice([" ", "\n", "  \t"]).join(w)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("window", "limits"), [(13, {}), (13, {"HOT": 2, "FEW": 1}), (5, {"CODES": 7, "REMEMBERED": 3}), (2, {"MOST_WINDOWS": 3}), (13, {"CHUNK_ROWS": 4})])
def test_substrings(spark, monkeypatch, window, limits):
    for name, value in limits.items():
        monkeypatch.setattr(substrings, name, value)
    docs = passages(window, 120, 40 if window == 13 else 400) + [(7, "a twin id " * 9), (7, "another text " * 20), (300, None), (301, ""), (None, "again " * 90)]
    docs += [(1000 + i, "the very same copy of a text that has many more words than a window has " * 2) for i in range(200)]
    got = substrings.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), window)
    assert Counter(map(tuple, got.collect())) == Counter(kept_words(docs, window))


def test_substrings_of_edge_cases(spark):
    rows = [(r[0], r[1]) for r in edge_cases.rows()]
    got = substrings.substring_dedup(edge_cases.frame(spark))
    assert Counter(map(tuple, got.collect())) == Counter(kept_words(rows, 13))
    assert substrings.substring_dedup(edge_cases.frame(spark).limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, ""), (2, "  \n"), (None, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in substrings.substring_dedup(empty).collect()} == {(0, 0, "")}


def test_equal_strings_of_a_task_travel_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(500)], "doc_id long, text string").coalesce(1)
    spans = substrings.shared_spans(docs).collect()
    assert len(spans) == 499 and {(r.start, r.end) for r in spans} == {(0, 60)}  # one span a copy: none went through a bucket


def test_codes():
    some = pa.array([f"w{i}".encode() for i in range(20_000)] + ["é".encode()], pa.binary())
    lexicon = substrings.Lexicon(some)
    words = pa.array([b"w0", b"w127", b"w128", b"new", b"w12415", b"w12416", b"w19999", "é漢".encode(), "é".encode(), b"x" * 400], pa.binary())
    written = lexicon.written(words)
    assert [len(x) for x in written.to_pylist()] == [1, 1, 2, 5, 2, 3, 3, 7, 3, 402] and len(set(written.to_pylist())) == 10
    assert lexicon.read(written) == words.to_pylist() and lexicon.read(lexicon.written(some)) == some.to_pylist()
    assert substrings.Lexicon(some.slice(0, 0)).read(substrings.Lexicon(some.slice(0, 0)).written(words)) == words.to_pylist()


def test_super_kmers_hold_every_window_once():
    rng = np.random.default_rng(5)
    hashes, bounds = rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.array([0, 0, 150, 155, 400])
    none = np.zeros(0, np.uint64)
    for common, hot in ((none, none), (none, np.sort(substrings.super_kmers(hashes, bounds, 13, none, none)[2])[:20]), (np.sort(hashes)[:200], none)):
        first, count, _ = substrings.super_kmers(hashes, bounds, 13, common, hot)
        assert [i for f, c in zip(first, count, strict=True) for i in range(f, f + c)] == [*range(0, 138), *range(155, 388)]


# clusters


def cluster(rows, k, rounds, seed, width, scale):
    kept = [(v, [int(Fraction(x) * scale // 1) for x in e]) for v, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, sha(f"{seed}:{kept[i][0]}"), kept[i][1]))
    centroids = [kept[i][1] for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, i) in zip(kept, own, strict=True) if i == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    total = Counter()
    for d, j in own:
        total[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return [(v, j, fits(d), fits(total[j]), fits(sum(total.values())), sha(",".join(map(str, centroids[j])))) for (v, _), (d, j) in zip(kept, own, strict=True)]


@pytest.mark.parametrize("kind", ["spread", "ties", "large", "few", "edge"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(3)
    width, k = 4, 5
    rows = [(i, [float(x) for x in rng.normal(size=width) * (1 + i % 3)]) for i in range(150)]
    if kind == "ties":
        rows = [(i, [float(x) / 1024 for x in rng.integers(-2, 3, width)]) for i in range(150)]
    if kind == "large":
        rows = [(i, [float(x) for x in rng.normal(size=width) * 10.0 ** (i % 9)]) for i in range(60)]
    if kind == "few":
        rows = rows[:3]
    if kind == "edge":
        rows += [(None, [1.0] * width), (500, None), (501, [1.0]), (502, [1.0, None, 1.0, 1.0]), (503, [float("nan")] * width), (504, [float("inf")] * width), (0, rows[0][1]), (5, [0.0] * width)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = kmeans.clusters(frame, k=k, rounds=4, width=width)
    assert Counter(map(tuple, got.collect())) == Counter(cluster(rows, k, 4, 3, width, 1024))
    assert kmeans.clusters(frame.limit(0), width=width).count() == 0


def test_sums_beyond_a_long_are_null(spark):
    frame = spark.createDataFrame([(i, [1e12 * (-1) ** i, 1e200]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = kmeans.clusters(frame, k=1, rounds=1, width=2).collect()
    assert len(rows) == 40 and {(r.distance, r.inertia) for r in rows} == {(None, None)}


def test_an_annulus_leaves_most_centroids_out():
    rng = np.random.default_rng(9)
    centroids = np.array([[r, 0] for r in range(0, 64_000, 1000)], np.int64)
    vectors = centroids[rng.integers(0, 64, 500)] + rng.integers(-3, 4, (500, 2))
    number, distance = kmeans.Annuli(centroids).nearest(vectors)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (every.argmin(axis=1) == number).all() and (every.min(axis=1) == distance).all()


# runs


def runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def random_words(rng, most):
    w = []
    for _ in range(rng.randint(1, 8)):
        if rng.random() < 0.6:
            p = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40, 70]))]
            w += (p * 40)[: rng.randint(1, min(400, len(p) * 8))]
        else:
            w += [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
    return (w + w[:1] * rng.randint(0, 600) if rng.random() < 0.3 else w)[:most]


def test_runs():
    rng = random.Random(13)
    for _ in range(400):
        w = random_words(rng, 700)
        assert periodic.find_runs(np.array(w, np.int64)) == runs(w), w
    assert periodic.find_runs(np.zeros(0, np.int64)) == []
    with pytest.raises(ValueError, match="three periods"):
        periodic.find_runs(np.zeros(9, np.int64), min_periods=2)


def test_lags_of_every_scale():
    rng = np.random.default_rng(1)
    for q in (31, 32, 63, 64, 65, 127, 500, 1024, 3001):
        w = rng.integers(0, 9, 16_000)
        a = int(rng.integers(0, 16_000 - 4 * q)) if 4 * q < 16_000 else 0
        w[a : a + 4 * q + 3] = np.resize(rng.integers(0, 9, q), min(4 * q + 3, 16_000 - a))
        assert any(p == q and s <= a and s + n >= a + 4 * q for s, n, p in periodic.find_runs(w))
    assert periodic.find_runs(np.zeros(500_000, np.int64)) == [(0, 500_000, 1)]


def expected(doc_id, text):
    w, n = words(text), len(words(text))
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{x}" for x in random_words(rng, 300))) for i in range(120)]
    rows += [(r[0], r[1]) for r in edge_cases.rows() if len(r[1] or "") < 20_000]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).repartition(3)
    got = periodic.periodic_runs(frame)
    assert Counter(map(tuple, got.collect())) == Counter(expected(*r) for r in rows)
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_a_long_text(spark):
    text = "lorem ipsum dolor sit amet " * 40_000
    row = periodic.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.collapsed) == (1, 0, 200_000, 5, "lorem ipsum dolor sit amet")
