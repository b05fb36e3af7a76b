"""Counts, joins, personal data, secrets, byte-level BPE and quality rules against brute force."""

import base64
import hashlib
from collections import Counter

import pytest

from tests.llm import brute
from tests.llm.edge_cases import SCHEMA, frame

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(params=["edge", "edges repeated", "table"])
def docs(request, spark, data):
    if request.param == "table":
        return spark.read.parquet(f"{data}/documents.parquet")
    return frame(spark, 1 if request.param == "edge" else 30)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_jaccard_components(docs):
    from spanloom.llm.jaccard_join import jaccard_components

    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k, percent in ((3, 90), (5, 80)):
        assert Counter(rows(jaccard_components(docs, k, percent))) == Counter(brute.components(texts, k, percent))


def test_pii(docs):
    from spanloom.llm.pii import KINDS, find_pii

    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        spans = brute.pii(r.text)
        expected[(r.doc_id, *(sum(s[0] == k for s in spans) for k in KINDS), brute.sha(spans))] += 1
    found = find_pii(docs).collect()
    assert Counter(tuple(r)[:6] for r in found) == expected
    for r in found:  # base spans stay
        assert sum(x.startswith(("email:", "ip:", "card:", "phone:")) for x in r.spans.split(",")) >= sum(r[1:5])


def test_pii_discovers_what_contexts_announce(spark):
    from spanloom.llm.pii import find_pii

    seeds = [(i, f"line {i} please reach me at user{i}@mail.example.org any day") for i in range(40)]
    new = [(100 + i, f"line {i} please reach me at id-{7000 + i}#home any day") for i in range(5)]
    other = [(200 + i, f"shelf number {9000 + i} is empty") for i in range(40)]
    spans = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(seeds + new + other, "doc_id long, text string")).collect()}
    assert all(spans[d].count("email:") == 1 for d, _ in seeds + new)
    assert all(spans[d] == "" for d, _ in other)


def test_pii_keeps_every_pattern(spark):
    from spanloom.llm.pii import find_pii, redact

    n = 5000  # contexts of five seeds and one other identifier: 15,000 patterns pass
    text = lambda i: "\n".join(f"left{i} ahead{i} {x} behind{i}" for x in [*(f"u{j}x{i}@mail.example.org" for j in range(5)), f"id-{10000 + i}#h"])
    docs = spark.range(n).rdd.map(lambda r: (r[0], text(r[0]))).toDF("doc_id long, text string")
    assert find_pii(docs).where("spans NOT RLIKE '^(email:[0-9]+:[0-9]+,){5}email:[0-9]+:[0-9]+$'").count() == 0
    assert redact(docs).where("text RLIKE '@|#'").count() == 0


def test_pii_discovers_over_several_hops(spark):
    from spanloom.llm.pii import find_pii

    seeds = [f"please reach me at user{i}@mail.example.org any day" for i in range(40)]
    first = [f"please reach me at id-{7000 + i}#home any day" for i in range(8)]
    second = [f"your badge number {x} opened it" for x in (*(f"id-{7000 + i}#home" for i in range(8)), "9911/zz")]
    third = [f"and the owner {x} slept well" for x in (*(f"id-{7000 + i}#home" for i in range(8)), "9922/yy" * 12)]
    texts = [*seeds, *first, *second, *third, *(f"shelf number {9000 + i} is empty" for i in range(40))]
    spans = {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(spans[i].count("email:") == 1 for i in range(40 + 8 + 9 + 9))
    assert all(spans[i] == "" for i in range(66, len(texts)))


def test_redactor(spark):
    from spanloom.llm.pii import redactor

    docs = spark.createDataFrame([(1, "to a.b@c.de, 10.1.2.3!"), (2, None), (3, "plain")], "doc_id long, text string")
    assert {r.t for r in docs.select(redactor(docs)("text").alias("t")).collect()} == {"to [EMAIL], [IP]!", None, "plain"}


def test_secrets(docs):
    from spanloom.llm.secrets import find_secrets

    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        spans = brute.secrets(r.text)
        expected[(r.doc_id, *(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")), brute.sha(spans))] += 1
    assert Counter(tuple(r)[:5] for r in find_secrets(docs).collect()) == expected


def test_secret_ownership(spark):
    from spanloom.llm.secrets import find_secrets

    example, live = "Zx9" * 10, "Qp7" * 10
    docs = spark.createDataFrame([(1, f"use {example}", "a", "en"), (2, f"use {example} now", "b", "en"), (3, f"mine {live}", "a", "en"), (4, "token=abcdefgh1", "c", "en")], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert [got[i].spans for i in (1, 2, 3)] == ["", "", "generic:5:35"]
    assert (got[4].n_owner_specific, got[4].n_copied) == (1, 0)


def test_secret_ownership_by_owners_and_repositories(spark):
    from spanloom.llm.secrets import find_secrets

    copied, wide, few = "Qp7" * 10, "Zx9" * 10, "Mw3" * 10
    rows = [(i, f"use {wide}", f"s{i}", "a", "r") for i in range(12)]  # many owners and repositories
    rows += [(20 + i, f"mine {copied}", f"s{i}", "a", "r") for i in range(2)]  # one document in two of 30 sources
    rows += [(30 + i, f"own {few}", "s1", "a", f"r{i}") for i in range(12)]  # many repositories of one owner
    rows += [(50 + i, "nothing", f"s{i}", "a", "r") for i in range(30)]
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, repo string"), repository=("repo",)).collect()}
    assert all(got[i].spans == "" for i in range(12))
    assert [(got[20 + i].spans, got[20 + i].n_owners, got[20 + i].n_repositories) for i in range(2)] == [("generic:5:35", "2", "2")] * 2
    assert all((got[30 + i].spans, got[30 + i].n_owners, got[30 + i].n_repositories) == ("generic:4:34", "1", "12") for i in range(12))


def test_byte_bpe(docs):
    import tiktoken

    from spanloom.llm.byte_bpe import byte_bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = own.encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())] += 1
    assert Counter(rows(byte_bpe(docs))) == expected


def test_quality(docs):
    from spanloom.llm.quality import quality

    expected = Counter((r.doc_id, *brute.quality(r.text)) for r in docs.select("doc_id", "text").collect())
    found = quality(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    assert not any(r.kept and r.base_failed for r in found)


def _distance(a, b):
    """Jensen-Shannon distance of two counters, base 2."""
    import math

    na, nb, total = sum(a.values()), sum(b.values()), 0.0
    if not na or not nb:
        return 0.0
    for k in set(a) | set(b):
        p, q = a[k] / na, b[k] / nb
        total += sum(x * math.log2(2 * x / (p + q)) for x in (p, q) if x)
    return math.sqrt(max(total, 0) / 2)


def test_quality_by_divergence(spark):
    from spanloom.llm import quality as q

    good = " ".join(["the house of the man that is at the end of it and was for a long time by this river"] * 4)
    words = good.split()
    texts = [(i, " ".join(words[i % 7 :] + [f"w{i}"] * 3), ["en", "fr"][i % 2]) for i in range(12)] + [(20, " ".join(f"x{i}#$%|" for i in range(90)), "en"), (21, " ".join(f"q{i} of" for i in range(60)), None)]
    common = set(q.common_word_list())
    kinds = lambda t: Counter("space" if c in " \n" else "lower" if c.islower() else "digit" if c.isdigit() else "symbol" if c in "#*$%&|<>" else "punctuation" for c in t)
    named = lambda t: Counter(w if w in common else "" for w in t.split())
    by_lang, pooled = {}, (Counter(), Counter())
    for _, t, lang in texts:
        for side in (by_lang.setdefault(lang, (Counter(), Counter())), pooled):
            side[0].update(kinds(t)), side[1].update(named(t))
    for r in q.quality(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect():
        _, t, lang = next(x for x in texts if x[0] == r.doc_id)
        chars, own = kinds(t), named(t)
        refs = by_lang[lang] if sum((by_lang[lang][1] - own).values()) >= r.n_words else pooled
        d = _distance(chars, refs[0] - chars), _distance(own, refs[1] - own)
        assert r.char_distance == pytest.approx(d[0], abs=1e-9) and r.word_distance == pytest.approx(d[1], abs=1e-9)
        far = r.n_words >= q.MIN_WORDS and r.word_chars >= q.MIN_CHARS and (d[0] > q.MAX_CHAR_DISTANCE or d[1] > q.MAX_WORD_DISTANCE)
        assert r.kept == (not r.base_failed and not far)


def test_token_counts(docs):
    from spanloom.llm.token_counts import MARK, load_pieces, token_counts

    pieces = load_pieces("piece_bpe_32k.model")
    unknown, longest = min(pieces.values()) - 10.0, max(map(len, pieces))
    known = {}

    def count(word):
        if word not in known:
            w = MARK + word
            best = [(0.0, 0)]
            for end in range(1, len(w) + 1):
                top = (float("-inf"), 0)
                for start in range(max(0, end - longest), end):
                    score = pieces.get(w[start:end])
                    if score is not None and best[start][0] + score > top[0]:
                        top = (best[start][0] + score, best[start][1] + 1)
                if w[end - 1] not in pieces and best[end - 1][0] + unknown > top[0]:
                    top = (best[end - 1][0] + unknown, best[end - 1][1] + len(w[end - 1].encode()))
                best.append(top)
            known[word] = best[-1][1]
        return known[word]

    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        words = brute.WORD.findall(r.text or "")
        expected[r.doc_id, len(words), sum(map(count, words))] += 1
    assert Counter(rows(token_counts(docs))) == expected


def test_empty_tables(spark):
    from spanloom.llm.byte_bpe import byte_bpe
    from spanloom.llm.jaccard_join import jaccard_components
    from spanloom.llm.pii import find_pii
    from spanloom.llm.quality import quality
    from spanloom.llm.secrets import find_secrets
    from spanloom.llm.token_counts import token_counts

    nothing = spark.createDataFrame([], SCHEMA)
    for operator in (byte_bpe, jaccard_components, find_pii, quality, find_secrets, token_counts):
        assert operator(nothing).collect() == []
