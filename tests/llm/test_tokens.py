"""Token counts, packing, byte-level BPE and token files against the libraries and brute force."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.edge_cases import SCHEMA, frame, rows

P = pytest.importorskip("public_tokenizers")


def whole(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_of_very_many_sources(spark):
    from pyspark.sql import functions as F

    from spanloom.llm.packing import pack

    small = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a few words of a small source").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    large = spark.range(3000, 3400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words of the large one "), 20).alias("text"), F.lit("large").alias("source"))
    pieces = pack(small.union(large).repartition(5), window=1, length=256).collect()
    assert {p.source for p in pieces} == {f"s{i}" for i in range(3000)} | {"large"}
    taken = defaultdict(int)
    for p in pieces:
        taken[p.sequence_id, p.source == "large"] += p.length
    share = sum(n for (_, big), n in taken.items() if big) / sum(taken.values())
    full = [i for i in {i for i, _ in taken} if taken[i, True] + taken[i, False] == 256]
    assert all(abs(taken[i, True] - share * 256) <= 1 for i in full)  # every window has its share


@pytest.mark.parametrize("source", ["edge", "table"])
def test_packing_round_trip(spark, data, source):
    from spanloom.llm.packing import pack

    docs = frame(spark) if source == "edge" else spark.read.parquet(f"{data}/documents.parquet")
    encode = whole("word_bpe_49k.json")
    expected = Counter()
    ids_of = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids_of[r.doc_id].append(encode(r.text) + [1])
    pieces = pack(docs).collect()
    for seq in ids_of.values():
        for ids in seq:
            expected[len(ids)] += 1
    assert sum(p.length for p in pieces) == sum(len(i) for s in ids_of.values() for i in s)
    for doc_id, texts in ids_of.items():
        if len(texts) == 1:
            own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
            at = 0
            for p in own:
                assert p.start == at and p.doc_tokens == len(texts[0]) and p.ids_crc32 == crc(texts[0][at : at + p.length])
                at += p.length
            assert at == len(texts[0])
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert sum(sum(x for _, x in parts) < 2048 for parts in by_sequence.values()) <= 11


def test_packing_keeps_the_mixture(spark, data):
    from spanloom.llm.packing import pack

    docs = spark.read.parquet(f"{data}/documents.parquet")
    window, length = 8, 256
    pieces = pack(docs, length=length, window=window).collect()
    total = Counter()
    for p in pieces:
        total[p.source] += p.length
    n = sum(total.values())
    per_window = defaultdict(Counter)
    for p in pieces:
        per_window[p.sequence_id * length // (window * length)][p.source] += p.length
    full = [k for k in per_window if (k + 1) * window * length <= n]
    for k in full:
        for s, t in total.items():
            assert abs(per_window[k][s] - t * window * length / n) <= len(total) + 1, (k, s)
    weights = {s: 1.0 + i for i, s in enumerate(sorted(total))}
    again = pack(docs, length=length, window=window, weights=weights).collect()
    first = Counter()
    for p in again:
        if p.sequence_id < window:
            first[p.source] += p.length
    for s, w in weights.items():
        assert abs(first[s] - window * length * w / sum(weights.values())) <= len(total) + 1
    assert sum(p.length for p in again) == n


def test_packing_of_nothing(spark):
    from spanloom.llm.packing import pack

    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("source", ["edge", "table"])
def test_token_files(spark, data, source):
    from spanloom.llm.pfor import token_files

    docs = frame(spark) if source == "edge" else spark.read.parquet(f"{data}/documents.parquet")
    encode = whole("byte_bpe_50k.json")
    expected = defaultdict(Counter)
    for r in docs.select("doc_id", "text").collect():
        ids = encode(r.text) + [2]
        expected[r.doc_id][len(ids), crc(ids)] += 1
    found = sorted(token_files(docs).collect(), key=lambda r: (r.start))
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in found:
        assert r.start == start
        expected[r.doc_id][r.n_tokens, r.ids_crc32] -= 1
        start += r.n_tokens
    assert not any(+c or -c for c in expected.values())
    assert token_files(docs.limit(0)).collect() == []


def test_blocks_round_trip():
    from spanloom.llm.pfor import BLOCK, pack_blocks, unpack_block

    rng = np.random.default_rng(3)
    for n in (1, 5, BLOCK, BLOCK + 1, 5 * BLOCK):
        for high in (1, 2, 300, 50_000, 2**32):
            ids = rng.integers(0, high, n).astype("<u4")
            ids[rng.random(n) < 0.01] = 2**32 - 1
            raw = b"".join(pack_blocks(ids))
            out, at = [], 0
            while at < len(raw):
                block, at = unpack_block(raw, at)
                out.append(block)
            assert np.array_equal(np.concatenate(out), ids)
