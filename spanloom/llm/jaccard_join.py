"""Operator 4, n-gram Jaccard join with adaptive multi-match prefixes.

1. Every document becomes the sorted hashes of its distinct shingles; documents with equal sets
   are one class, so copies are joined by their class and never paired.
2. A count sketch of fixed size (``2**SKETCH_BITS`` counters, summed over all documents) estimates how
   many documents hold a shingle. Shingles are ordered rare ones first. Any order is exact for the
   prefix rule; the sketch only makes posting lists short.
3. With overlap at least o = ceil(t * n), two linked sets share l shingles in their first n - o + l
   ones. Each document takes the l from 1 to ``MAX_MATCHES`` with the least estimated cost (lengths of
   the posting lists of the longer prefix, plus verification of the fewer candidates that share l).
   A pair must share the smaller of its two l in the prefixes for that l.
4. Posting lists are worked off in rounds. A list is a group of any size, so it is never gathered:
   some of its classes become leaders (a minimum with map-side combine, by the hash of the class, so that the
   lists of one group of near copies elect the same ones), and each other class of the list is held against
   them: by length and place of the shared shingle, each pair once by bitmaps of the sets, then by shared
   prefix shingles, then in full. Near copies share most of their lists; after the first round, only one of the lists
   in which a class meets a leader makes the pair. Two classes that are already in one component need no check. A leader that
   has met its whole list leaves it; a list whose rest lies in one component is done. The first rounds take
   1, 8 and 64 leaders, which gathers the large components; later ones take many, but none from a list's
   largest component: a pair that is still open has one end outside it. So all pairs of a list are decided at the end.

The components so found are those of all links. Pairs within a copy group or a near-copy group are
not emitted: what is written per round is linear in the lists.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.components import connected_components
from spanloom.llm.store import discard, materialize, tasks_for

SKETCH_BITS, SKETCH_PARTS = 21, 64
MAX_MATCHES = 4
#: Leaders that a posting list has in the first rounds; in each further round ``MORE_LEADERS`` times as many as before.
FIRST_LEADERS, MORE_LEADERS = (1, 8, 64), 64
#: Bitmaps of 64 bits each: of the whole set up to so many shingles, else of the prefix.
MARKS, MARKED_WHOLE = tuple(f"s{i}" for i in range(16)), 1024
#: Lists that a class, and a leader, name to each other to settle which of those they share makes the pair; one made by more is only made again.
NAMED_LISTS = 32
#: Classes with over a hundredth of all rows; there can be no more than a hundred.
HOT_SHARE = 100
#: Documents whose sets are fetched for verification pass a bitmap of this many bits first (1 MB).
BITMAP_BITS = 1 << 23


def _sets(batch_text: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes), lower case for A-Z."""
    data, offsets = tx.doc_bytes(batch_text)
    for i, j in tx.doc_slices(offsets):
        _, _, hashes, bounds = tx.words(data[offsets[i] : offsets[j]], offsets[i : j + 1], lower=True)
        found, first = tx.shingles(hashes, bounds, shingle)
        for d in range(j - i):
            yield i + d, np.unique(found[first[d] : first[d + 1]])


def _overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def _class_key(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def document_sets(docs: DataFrame, shingle: int, digests: bool = False) -> DataFrame:
    """One row per document (doc_id, digest of the text, n, cls), and the partial sketches of each task (part, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen = False
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for row, members in _sets(batch.column(1), shingle):
                n[row] = len(members)
                if len(members):
                    cls[row] = _class_key(members)
                    at = (members >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    _add(sketch, at)
            seen = seen or batch.num_rows > 0
            yield _rows(batch.column(0), batch.column(2), pa.array(n), pa.array(cls, pa.binary()))
        if seen:
            for part, counts in enumerate(sketch.reshape(SKETCH_PARTS, -1)):
                yield _rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), part, zlib.compress(counts.tobytes(), 1))

    def _rows(ids: pa.Array, digests: pa.Array, n: pa.Array, cls: pa.Array, part: int | None = None, counts: bytes | None = None) -> pa.RecordBatch:
        k = len(ids)
        return pa.RecordBatch.from_arrays([ids, digests, n, cls, pa.array([part] * k, pa.int32()), pa.array([counts] * k, pa.binary())], names=["doc_id", "digest", "n", "cls", "part", "counts"])

    digest = F.md5("text") if digests else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", digest.alias("digest")).mapInArrow(scan, "doc_id long, digest string, n long, cls binary, part int, counts binary")


def _add(sketch: np.ndarray, at: np.ndarray) -> None:
    """Sorted positions: runs are added at once."""
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sketch[at[edge]] += np.diff(np.append(edge, len(at))).astype(np.uint32)


def frequency_sketch(parts: DataFrame) -> np.ndarray:
    """The summed sketch; its size is fixed, so it can be sent to the driver and to all tasks."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint32)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(blob), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def add_table(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(add(key, iter(table.to_batches()))))

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    for row in parts.groupBy("part").applyInArrow(add_table, "part int, counts binary").collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out.reshape(-1)


def choose_matches(df_in_order: np.ndarray, base: int, n: int) -> int:
    """The number of matches with the least estimated cost; ``df_in_order`` are the frequencies by prefix position."""
    best, least = 1, None
    lists = np.cumsum(df_in_order)
    for matches in range(1, MAX_MATCHES + 1):
        length = base + matches - 1
        if length > n or length > len(df_in_order):
            break
        cost = lists[length - 1] + lists[length - 1] / matches * (base + matches)
        if least is None or cost < least:
            best, least = matches, cost
    return best


def prefixes(docs: DataFrame, sketch: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """doc_id, n, cls, matches (l) and the prefix shingles in order, as signed longs."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            n, matches, rows, cls = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, np.int32), [], []
            marks = np.zeros((batch.num_rows, len(MARKS)), np.int64)
            for row, members in _sets(batch.column(1), shingle):
                n[row] = size = len(members)
                cls.append(_class_key(members))
                if not size:
                    rows.append(members)
                    continue
                df = counts[(members >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                base = size - int(_overlap(size, percent)) + 1
                keep = min(size, base + MAX_MATCHES - 1)
                order = np.lexsort((members, df))[:keep]
                matches[row] = m = choose_matches(df[order].astype(np.float64), base, size)
                rows.append(members[order[: base + m - 1]])
                marks[row] = _signature(members if size <= MARKED_WHOLE else rows[-1])
            first = np.zeros(len(rows) + 1, np.int64)
            np.cumsum([len(x) for x in rows], out=first[1:])
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cls, pa.binary()), pa.array(matches), tx.list_array(flat.view(np.int64), first, pa.int64()), *map(pa.array, marks.T)], names=["doc_id", "n", "cls", "matches", "prefix", *MARKS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n long, cls binary, matches int, prefix array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def _signature(members: np.ndarray) -> np.ndarray:
    """A bitmap of the shingles, 64 bits for each of MARKS."""
    bits = np.zeros(64 * len(MARKS), np.uint8)
    bits[(members & np.uint64(64 * len(MARKS) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(">i8").astype(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, members) of the classes in ``wanted`` (id, cls, rep): the texts are scanned, only wanted sets are sent on."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("rep"), F.lit(BITMAP_BITS))
    placed = lambda df: df.withColumn("b", bit).withColumns({"bucket": F.bitmap_bucket_number("b"), "at": F.bitmap_bit_position("b")}).drop("b")
    per_bucket = placed(wanted.select("rep")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    bitmap = np.zeros((BITMAP_BITS // 32768 + 2, 4096), np.uint8)
    for row in per_bucket.collect():  # BITMAP_BITS / 32768 rows at most
        bitmap[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            bucket, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hit = (bits[bucket, at // 8] >> (at % 8).astype(np.uint8)) & 1
            some = batch.filter(pa.array(hit.astype(bool)))
            rows, keys = [], []
            for _, members in _sets(some.column(1), shingle):
                rows.append(members)
                keys.append(_class_key(members) if len(members) else b"")
            for k in range(0, len(rows), 512):
                part = rows[k : k + 512]
                first = np.zeros(len(part) + 1, np.int64)
                np.cumsum([len(x) for x in part], out=first[1:])
                yield pa.RecordBatch.from_arrays([some.column(0).slice(k, len(part)), pa.array(keys[k : k + 512], pa.binary()), tx.list_array(np.concatenate(part).view(np.int64), first, pa.int64())], names=["rep", "cls", "members"])

    found = placed(docs.select(F.col("doc_id").cast("long").alias("rep"), "text")).mapInArrow(scan, "rep long, cls binary, members array<long>")
    return _of_class(found.withColumnRenamed("rep", "doc_id"), wanted).select("id", "members")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            (xs, xo), (ys, yo) = ((c.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(c.value_lengths().to_numpy()))) for c in (batch.column(2), batch.column(3)))
            for k in range(batch.num_rows):
                x, y = xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]]
                both_n = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good[k] = 100 * both_n >= percent * (len(x) + len(y) - both_n)
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.mapInArrow(check, "a long, b long")


def _of_class(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the classes' representatives, with the classes' id: one row a class, though ids may repeat in the input."""
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    of = classes.select("id", key("rep").alias("rep"), "cls")
    # duplicates are told by the columns of the join, which has dealt out the rows by these already
    return found.withColumn("rep", key("doc_id")).join(of, ["rep", "cls"]).dropDuplicates(["rep", "cls"])


def _grouped(docs: DataFrame, shingle: int, percent: int, digests: bool) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, digest, n, cls), and each class's component: cls, copies, all_rows, first (its row to stay)."""
    scanned = materialize(document_sets(docs, shingle, digests), "sets")
    scans = max(docs.sparkSession.sparkContext.defaultParallelism, len(scanned.inputFiles()))  # tasks that have read the documents; what has no more rows is written by so many
    members = scanned.where("part IS NULL").select("doc_id", "digest", "n", "cls")
    sketch = frequency_sketch(scanned.where("part IS NOT NULL").select("part", "counts"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest"))
    classes = members.where("n > 0").groupBy("cls").agg(least.alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumns({"id": F.monotonically_increasing_id(), "rep": F.col("first.doc_id")}).coalesce(scans), "classes")  # the written id is what all later steps read
    labels = _link_classes(docs, classes, sketch, shingle, percent, scans)
    named = labels.join(classes, labels.node == classes.id).select("cls", "component", "first")
    names = named.groupBy("component").agg(F.min("first").alias("least"))
    by_class = classes.select("cls", "copies", "first").join(named.join(names, "component").select("cls", "least"), "cls", "left")
    return members, by_class.select("cls", "copies", F.coalesce("least", "first").alias("first"))


def _with_first(members: DataFrame, by_class: DataFrame) -> DataFrame:
    """The rows with a set, and ``first`` of their component. Rows of the hottest classes get it from a broadcast of at most HOT_SHARE rows."""
    full = members.where("n > 0")
    limit = full.count() // HOT_SHARE
    hot, rest = F.broadcast(by_class.where(F.col("copies") > limit)), by_class.where(F.col("copies") <= limit)
    return full.join(hot, "cls").select(*members.columns, "first").union(full.join(hot, "cls", "left_anti").join(rest, "cls").select(*members.columns, "first"))


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included): one row per row of ``docs``.

    Links: two sets of ``shingle``-word shingles with Jaccard similarity of ``percent``/100 at least.
    Null or empty text has no set and links with nothing. A null doc_id takes part in links, but
    names no component (a component of null ids alone has a null id). Rows that share a doc_id and
    a text are copies of each other. Only doc_id and text are read.
    """
    members, by_class = _grouped(docs, shingle, percent, digests=False)
    out = _with_first(members, by_class).select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))
    return out.union(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def surplus_rows(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (doc_id, digest) of the rows that a smaller row of their component stands for, and of repeated rows that stay.

    ``digest`` is md5 of the text. Rows are ordered by doc_id (nulls last), then digest.
    """
    members, by_class = _grouped(docs, shingle, percent, digests=True)
    rows = materialize(_with_first(members, by_class).groupBy("doc_id", "digest").agg(F.first("first").alias("first"), F.count("*").alias("n")), "rows")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return rows.where(~stays).select("doc_id", "digest"), rows.where(stays & (F.col("n") > 1)).select("doc_id", "digest")


def _enough_shared(pairs: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough prefix shingles to be links at all.

    In the prefixes for the smaller l of the two, l shingles. In the whole prefixes, as many as the
    overlap that the pair's sizes ask for, less the longer of the two rests: a common shingle that is
    not in both prefixes lies in the rest of the set whose prefix ends first.
    """
    side = lambda k: prefix.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("matches").alias(f"m{k}"), F.col("prefix").alias(f"p{k}"))
    matches = F.least("ma", "mb")
    cut = lambda k: F.slice(f"p{k}", 1, (F.col(f"n{k}") - F.ceil(F.lit(percent) * F.col(f"n{k}") / 100)).cast("int") + matches)
    overlap = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((F.size(F.array_intersect(cut("a"), cut("b"))) >= matches) & (F.size(F.array_intersect("pa", "pb")) >= overlap - rest)).select("a", "b")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether two classes (n, pn and the bitmaps, behind the prefixes a and b) may be linked: shingles of one whose bits the other lacks are not in the other."""
    c = lambda k, name: F.col(k + name)
    lacking = lambda x, y: reduce(add, (F.bit_count(c(x, m).bitwiseAND(F.bitwise_not(c(y, m)))) for m in MARKS))
    in_sets = F.least(c(a, "n") - lacking(a, b), c(b, "n") - lacking(b, a))
    in_prefixes = F.least(c(a, "pn") - lacking(a, b), c(b, "pn") - lacking(b, a)) + F.greatest(c(a, "n") - c(a, "pn"), c(b, "n") - c(b, "pn"))
    whole = lambda k: c(k, "n") <= MARKED_WHOLE
    common = F.when(whole(a) & whole(b), in_sets).when(~whole(a) & ~whole(b), in_prefixes).otherwise(F.least(c(a, "n"), c(b, "n")))
    return (100 + percent) * common >= percent * (c(a, "n") + c(b, "n"))


def _in_one_list(rows: DataFrame, lead: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Rows (token, id) and leaders (token, leader) with some lists of each, and whether a list is the one to make their pair.

    It is drawn from the lists that both name; where there is none, each list makes the pair.
    """
    some = F.slice(F.array_sort(F.collect_set("token")), 1, NAMED_LISTS)
    rows = rows.join(rows.groupBy("id").agg(some.alias("held")), "id")
    lead = lead.join(lead.groupBy("leader").agg(some.alias("led")), "leader")
    draw = lambda token: F.xxhash64(token, "id", "leader")
    return rows, lead, F.coalesce(F.array_min(F.transform(F.array_intersect("held", "led"), draw)), draw("token")) == draw("token")


def _link_classes(docs: DataFrame, classes: DataFrame, sketch: np.ndarray, shingle: int, percent: int, scans: int) -> DataFrame:
    """(node, component) of the ids of all classes that have a link. ``scans``: tasks that read the documents."""
    prefix = _of_class(prefixes(docs, sketch, shingle, percent).where("n > 0"), classes)
    prefix = materialize(prefix.select("id", "n", "matches", "prefix", *MARKS).coalesce(scans), "prefixes")
    marked = prefix.select("id", "n", F.size("prefix").alias("pn"), *MARKS)
    side = lambda k: marked.select(*(F.col(c).alias(k + c) for c in marked.columns))
    posting = prefix.select(F.posexplode("prefix").alias("pos", "token"), "id", "n")
    shared = posting.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    slim = ["token", "id", "n", "pos", "m"]
    lists = materialize(posting.join(shared, "token").select(*slim).coalesce(scans), "lists")
    open_lists, labels, turn, leaders = lists.withColumns({"component": F.col("id"), "main": F.lit(-1).cast("long")}), None, 0, 1
    while True:
        tasks = tasks_for(open_lists)
        leaders = FIRST_LEADERS[turn] if turn < len(FIRST_LEADERS) else leaders * MORE_LEADERS
        may_lead = open_lists if turn < len(FIRST_LEADERS) else open_lists.where("component <> main")
        order = F.struct(F.xxhash64("id").alias("h"), "id", "n", "pos", "component")
        lead = may_lead.groupBy("token", F.pmod(F.xxhash64("id"), F.lit(leaders)).alias("part")).agg(F.min(order).alias("l"))
        lead = lead.select("token", F.col("l.id").alias("leader"), *(F.col(f"l.{c}").alias(f"l{c}") for c in ("n", "pos", "component")))
        lead = materialize(lead.coalesce(tasks), "lead") if turn else lead
        near = (F.col("id") != F.col("leader")) & (F.col("component") != F.col("lcomponent")) & (100 * F.least("n", "ln") >= percent * F.greatest("n", "ln"))
        # shingles have one order, so a shared one at these places leaves that many that can be common
        most = F.least("pos", "lpos") + F.least(F.col("n") - F.col("pos"), F.col("ln") - F.col("lpos"))
        near = near & ((100 + percent) * most >= percent * (F.col("n") + F.col("ln")))
        rows, leading = open_lists, lead
        if turn:  # in the first round the bitmaps are held against distinct pairs, later on against the few rows of open lists
            bits = ["pn", *MARKS]
            led = marked.select(F.col("id").alias("leader"), *(F.col(c).alias(f"l{c}") for c in bits))
            rows, leading, drawn = _in_one_list(rows.join(marked.select("id", *bits), "id"), lead.join(led, "leader"))
            near = near & _alike("", "l", percent) & drawn
        met = rows.join(leading, "token").where(near).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        if not turn:
            met = met.join(side("a"), F.col("a") == F.col("aid")).join(side("b"), F.col("b") == F.col("bid")).where(_alike("a", "b", percent)).select("a", "b")
        pairs = materialize(_enough_shared(met, prefix, percent).coalesce(scans), "pairs")
        wanted = materialize(classes.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id").select("id", "cls", "rep").coalesce(scans), "wanted")
        sets = materialize(sets_of(docs, wanted, shingle).coalesce(scans), "members")
        links = _verify(pairs, sets, percent).coalesce(tasks_for(pairs, sets))
        before = labels
        if before is not None:  # earlier links, as stars
            links = links.union(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = connected_components(links)
        rest = (open_lists if turn else open_lists.where("m > 2")).select(*slim)
        rest = rest.join(lead.select("token", F.col("leader").alias("id")), ["token", "id"], "left_anti")
        rest = rest.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        rest = materialize(rest.coalesce(tasks), "rest")
        if turn + 1 < len(FIRST_LEADERS):
            apart = rest.groupBy("token").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one < other").withColumn("main", F.lit(-1).cast("long"))
        else:
            by_component = rest.groupBy("token", "component").agg(F.count("*").alias("k"))
            apart = by_component.groupBy("token").agg(F.count("*").alias("apart"), F.max(F.struct("k", "component"))["component"].alias("main")).where("apart > 1")
        after = materialize(rest.join(apart.select("token", "main"), "token").select(*slim, "component", "main").coalesce(tasks), "open")
        discard(pairs, wanted, sets, before, rest, open_lists if turn else lists, lead if turn else None)
        open_lists, turn = after, turn + 1
        if not open_lists.limit(1).count():
            discard(open_lists, prefix)
            return labels
