"""Nearest neighbours against a full comparison."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm.hnsw import every_nth, nearest


def exact(rows, k):
    """query -> [(vec_id, score)]; rows: (id, list) that may be unusable."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    asked = {}
    for i, v in good:
        if i % 20 == 0 and (i not in asked or list(v) < list(asked[i])):
            asked[i] = v
    for q, v in asked.items():
        scores = sorted(((-float(x @ v), i) for i, x in good if i != q and len(x) == len(v)))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        mine = out.setdefault(r.query_id, [])
        mine.append((r.vec_id, r.score))
        assert r["rank"] == len(mine)
    return out


def recall(got, want):
    hit = sum((Counter(i for i, _ in got.get(q, [])) & Counter(i for i, _ in w)).total() for q, w in want.items())
    return hit / sum(map(len, want.values()))


def check(spark, df, least, shard_rows=16_384):
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = found(nearest(df.where(every_nth(df)), df, shard_rows=shard_rows))
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    assert recall(got, want) >= least
    for q, w in want.items():
        known = {}
        for i, score in w:
            known.setdefault(i, []).append(score)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] <= b[0]) for a, b in zip(got.get(q, []), got.get(q, [])[1:], strict=False))
        assert all(min(abs(s - t) for t in known[i]) <= 1e-9 * max(1, abs(s)) for i, s in got.get(q, []) if i in known)


def test_table(spark, data):
    check(spark, spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), 0.98)


def test_large_shards_copies_and_norms(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 6000)] + 0.3 * rng.normal(size=(6000, 24))) * rng.lognormal(0, 1, 6000)[:, None]
    x[1000:3000] = x[1000]  # a third of the rows are copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    check(spark, df, 0.95)
    check(spark, df, 0.95, shard_rows=300)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (20, [1.0, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [1e153, 1e153, 1.0]), (80, [1e-300, 0.0, 0.0]), (100, None), (120, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(spark, df, 1.0)
    assert nearest(df.limit(0), df).collect() == []
    assert nearest(df, df.limit(0)).collect() == []
