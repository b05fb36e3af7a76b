"""Components against brute force; small tables are not written as a file for each partition of a shuffle."""

import random

import pytest


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_write_few_files(many_partitions):
    from spanloom.llm.components import connected_components

    draw, spark = random.Random(11), many_partitions
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(130)] + [(i, i + 1) for i in range(400, 460)] + [(700, i) for i in range(600, 640)]
    links += [(b, a) for a, b in links[::3]] + [(None, 5), (9, None), (8, 8)]  # links twice, nulls, a loop
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    labels = connected_components(spark.createDataFrame(links, "a long, b long").repartition(3))
    assert sorted(labels.collect()) == sorted((x, find(x)) for x in root)
    assert len(labels.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
