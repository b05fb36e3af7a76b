"""The fixity audit against a record-by-record comparison."""

import hashlib
import os
import uuid
from collections import Counter, defaultdict

from spanloom.llm import warc

SCHEMA = "page_id long, url string, html string, file string, offset string"


def folders(tmp_path):
    top = f"file://{tmp_path}/{uuid.uuid4().hex}"
    return (f"{top}/a", f"{top}/b")


def path(folder, name):
    return os.path.join(folder.removeprefix("file://"), name)


def test_records_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "f", "o"), (None, None, None, None, None), (2, "u", "", "", ""), (3, "long", "<p>" * 500_000, "", ""), (1, "http://a/\r\nX: y", "<p>é</p>", "f", "o")]
    a, b = folders(tmp_path)
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), (a, b)).collect()
    found = Counter()
    ends = defaultdict(list)
    for r in index:
        raw = open(path(a, r.file), "rb").read()[r.offset : r.offset + r.length]
        headers, body = warc.parse(raw)
        found[r.page_id, body.decode()] += 1
        assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        ends[r.file].append((r.ordinal, r.offset, r.length))
    assert found == Counter((r[0], r[2] or "") for r in rows)
    for parts in ends.values():
        at = 0
        for k, (ordinal, offset, length) in enumerate(sorted(parts)):
            assert (ordinal, offset) == (k, at)
            at += length
    assert all(r.intact for r in warc.audit(spark.createDataFrame(index), (a, b)).collect())


def test_planted_faults_are_located(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    both = pages.union(pages).union(pages)
    got = warc.archived_and_audited(both).collect()
    bad = {r.page_id for r in pages.collect() if hashlib.sha256(warc.record(r.page_id, r.url, r.html)).digest()[0] == 0}
    assert bad and len(got) == both.count()
    assert {r.page_id for r in got if not r.intact} == bad
    assert sum(not r.intact for r in got) == 3 * len(bad)


def test_lost_and_short_files(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").repartition(3)
    a, b = folders(tmp_path)
    index = warc.write_archives(pages, (a, b))
    files = sorted({r.file for r in index.collect()})
    os.rename(path(b, files[0]), path(b, "gone"))
    size = os.path.getsize(path(b, files[1]))
    with open(path(b, files[1]), "r+b") as f:
        f.truncate(size // 2)
    for r in warc.audit(index, (a, b)).collect():
        assert r.intact == (r.file == files[2] or (r.file == files[1] and r.offset + r.length <= size // 2))


def test_only_differing_branches_are_read(spark):
    """A difference below a sound node stays unseen: its children are not compared."""
    leaf = lambda mark: [("f", i, f"{mark if i == 40 else ''}{i}".encode(), i, i + 1) for i in range(300)]
    make = lambda mark: spark.createDataFrame(leaf(mark), "file string, node long, digest binary, first long, end long")
    ours, theirs = warc.tree(make("")), warc.tree(make("x"))
    assert len(ours) == 4
    assert [tuple(r) for r in warc.differing_leaves(ours, theirs).collect()] == [("f", 40)]
    theirs[3] = ours[3]
    assert warc.differing_leaves(ours, theirs).collect() == []


def test_no_pages(spark):
    assert warc.archived_and_audited(spark.createDataFrame([], SCHEMA)).collect() == []
