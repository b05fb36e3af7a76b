"""Posting lists of near copies: every pair is made, and in one of the lists that it shares."""

import random
from collections import Counter

import pytest

from tests.llm import brute


@pytest.mark.parametrize("tokens", [30, 150])
def test_a_pair_is_made_in_one_list(spark, tokens):
    from spanloom.llm.jaccard_join import _in_one_list

    draw = random.Random(tokens)
    lists = [(t, i) for t in range(tokens) for i in range(40) if draw.random() < 0.6]
    leaders = [(t, i) for t, i in lists if draw.random() < 0.3]
    rows, lead, drawn = _in_one_list(spark.createDataFrame(lists, "token long, id long"), spark.createDataFrame(leaders, "token long, leader long"))
    made = Counter((r.id, r.leader) for r in rows.join(lead, "token").where(drawn).select("id", "leader").collect())
    every = Counter((i, j) for t, i in lists for u, j in leaders if t == u)
    assert made.keys() == every.keys()
    if tokens < 32:  # all are named
        assert set(made.values()) == {1}
    assert made.total() * 2 < every.total()


def test_components_of_a_family(spark):
    from spanloom.llm.jaccard_join import jaccard_components

    draw = random.Random(7)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(160):  # from the text itself to far from it
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 6])):
            words[draw.randrange(len(words))] = f"v{draw.randrange(40)}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (5, 80)):
        assert Counter(tuple(r) for r in jaccard_components(docs, k, percent).collect()) == Counter(brute.components(texts, k, percent))
