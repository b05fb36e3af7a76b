"""Snapshots: what goes out, what is refused, and imports that add nothing twice."""

import random

from pyspark.sql import functions as F

from spanloom.sources import snapshots as sn

WINDOWS = "asset string, id string, start double, end double, confidence double, state string"
ASSETS = "asset string, podcast string, sha string, version int, duration double"


def test_export(spark):
    windows = [("a", "2", 10.0, 20.0, 0.5, "confirmed"), ("a", "1", 0.0, 5.0, 1.0, "suppressed"), ("a", "3", 30.0, 29.0, 0.5, "confirmed"), ("a", "4", 40.0, 41.0, 0.5, "confirmed"), ("b", "5", 0.0, 101.0, 0.5, "confirmed"), ("c", "6", 0.0, 1.0, 0.5, "confirmed"), ("d", "7", 0.0, 1.0, 0.5, "odd"), ("e", None, 0.0, 1.0, 0.5, "confirmed"), ("f", "8", float("nan"), 1.0, 0.5, "confirmed")]
    assets = [(x, "p", f"f{x}", 1, 100.0) for x in "abdef"] + [("c", "", "fc", 1, None)]
    got = sn.export(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(assets, ASSETS), 1.0).collect()
    assert [(r.sha, r.coverage_end, [w.id for w in r.windows]) for r in got] == [("fa", 20.0, ["1", "2"])]
    assert got[0].name == "".join(spark.range(1).select(F.sha2(F.lit("1:p2:fa1:1"), 256)).first())


def test_refusals(spark):
    assets = spark.createDataFrame([("a", "p", "f", 3, 100.0)], ASSETS)
    good = sn.export(spark.createDataFrame([("a", "1", 0.0, 5.0, 1.0, "confirmed"), ("a", "2", 7.0, 9.0, 1.0, "candidate")], WINDOWS), assets, 1.0)
    reason = lambda df: [r.reason for r in sn.refusals(df, assets).collect()]
    assert reason(good) == [None]
    changes = {"schemaVersion": ("schema_version", F.lit(1_000)), "analysisVersion": ("version", F.lit(2)), "exportedAt": ("exported_at", F.lit(-1.0)), "windows": ("windows", F.array().cast(good.schema["windows"].dataType)), "coverageEnd": ("coverage_end", F.lit(8.0)), "windowId": ("windows", F.concat("windows", F.slice("windows", 1, 1)))}
    for expected, (column, value) in changes.items():
        assert reason(good.withColumn(column, value)) == [expected]
    assert reason(good.withColumn("windows", F.transform("windows", lambda w: w.withField("confidence", F.lit(2.0))))) == ["window"]
    assert [r.reason for r in sn.refusals(good, assets.withColumn("duration", F.lit(8.0))).collect()] == ["duration"]
    assert reason(good.withColumn("sha", F.lit("other"))) == []
    assert sn.imported(good.withColumn("version", F.lit(2)), assets, spark.createDataFrame([], WINDOWS)).count() == 0


def test_import_twice(spark):
    rng = random.Random(7)
    own, there = [], []
    for a in range(40):
        for i in range(rng.randrange(1, 25)):
            start = rng.randrange(200) / 8
            own.append((f"a{a}", f"{a}-{i}", start, start + rng.choice([1.0, 1.125, 2.0]), 0.5, rng.choice(["confirmed", "suppressed", "candidate"])))
            if rng.random() < 0.3:
                there.append((f"a{a}", rng.choice([f"{a}-{i}", f"s{a}-{i}"]), start + rng.choice([0.0, 0.25, 0.5, 3.0]), start + 1.25, 0.9, "confirmed"))
    assets = spark.createDataFrame([(f"a{a}", "p", f"f{a}", 1, 1000.0) for a in range(40)], ASSETS)
    store = spark.createDataFrame(there, WINDOWS)
    snapshots = sn.export(spark.createDataFrame(own, WINDOWS), assets, 1.0)
    got = {tuple(r) for r in sn.imported(snapshots, assets, store).collect()}
    kept, expected = list(there), set()
    for w in sorted(own, key=lambda w: (w[0], w[2], w[3], w[1])):
        if w[5] != "candidate" and not any(k[0] == w[0] and (k[1] == w[1] or (abs(k[2] - w[2]) <= 0.25 and abs(k[3] - w[3]) <= 0.25)) for k in kept):
            kept.append(w)
            expected.add(w)
    assert got == expected and len(got) > 100
    again = store.unionByName(spark.createDataFrame(sorted(got), WINDOWS))
    assert sn.imported(snapshots, assets, again).count() == 0
