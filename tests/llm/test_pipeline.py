"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter

import pytest

from tests.llm import brute
from tests.llm.edge_cases import frame

pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(params=["edge", "table"])
def docs(request, spark, data):
    return spark.read.parquet(f"{data}/documents.parquet") if request.param == "table" else frame(spark, 2).select(COLUMNS)


def key(rows):
    return Counter(tuple(r) for r in rows)


def test_stages(spark, data, docs):
    import corpus_pipeline as cp
    from spanloom.llm.pii import find_pii
    from spanloom.llm.quality import quality

    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "personal data", "packing"]
    rows = docs.collect()
    kept = cp.quality_rules(spark, docs, data)
    assert kept.columns == COLUMNS
    verdicts = Counter((r.doc_id, r.kept) for r in quality(docs).collect())
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for (d, k), n in verdicts.items() if k})

    unique = cp.near_duplicates(spark, docs, data)
    assert unique.columns == COLUMNS
    assert key(unique.collect()) == key(brute.one_of_each_group(rows, 5, 80))

    clean = cp.personal_data(spark, docs, data)
    assert clean.columns == COLUMNS
    spans = {}
    for r in find_pii(docs).collect():
        spans.setdefault(r.doc_id, set()).add(r.spans)
    before = {r.doc_id: r.text for r in rows}
    for r in clean.collect():
        assert r.n_chars == len(r.text or "")
        if spans[r.doc_id] == {""}:
            assert r.text == before[r.doc_id] or Counter(x.doc_id for x in rows)[r.doc_id] > 1
        elif len(spans[r.doc_id]) == 1:
            assert any(f"[{k}]" in r.text for k in ("EMAIL", "IP", "CARD", "PHONE")) and not brute.pii(r.text)


def test_unique_text_stays_with_its_namesake(spark, data):
    import corpus_pipeline as cp

    copied, other = "one two three four five six seven", "quite another text of eight words is here"
    docs = spark.createDataFrame([(1, copied), (5, copied), (5, other), (5, other), (None, other), (None, "alone and without a name"), (7, None), (7, None)], "doc_id long, text string")
    left = key(cp.near_duplicates(spark, docs, data).collect())
    assert left == Counter({(1, copied): 1, (5, other): 1, (None, "alone and without a name"): 1, (7, None): 2})


def test_run(spark, data):
    import corpus_pipeline as cp

    pieces = cp.run(spark, data).collect()
    assert pieces and len({p.doc_id for p in pieces}) < spark.read.parquet(f"{data}/documents.parquet").count()


def test_run_on_nothing(spark, docs, data):
    import corpus_pipeline as cp

    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), data).collect() == []
