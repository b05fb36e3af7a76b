"""Operator 11, substring dedup: words in windows that an earlier document has too are removed; windows meet by super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the least hash of its two-word grams, grams of frequent words
coming last, so that no bucket is filled by a phrase that all texts use; consecutive windows mostly share it, and such a stretch (a super-k-mer) travels as one packed string to the bucket of its minimiser. Equal
windows have equal minimisers, so they meet in a bucket, where sorting their word numbers counts them exactly: no hash
decides what is equal. A packed string holds one to three bytes for each of the most frequent words (any number of bytes of 0x20 to
0x7F, then one of 0x80 to 0xFF, short ones first); all others are spelled between a tab and a line feed, which no word holds.

What keeps large groups apart:

* Of equal strings in a slice of a task, or behind one that the task has seen to be copied, only those of the least
  document travel; the others are decided where they stand, and go to the result as a span. So a passage with a
  billion copies sends its bucket about one row a task.
* Near copies differ, and their strings would all meet. A scan finds the minimisers with more than ``HOT``
  different strings (or a millionth of all, so there are a million at most, which is what tasks are sent); windows under
  these travel singly, to a bucket of their own. A scan before counts words, for codes and grams.
* A string holds at most ``MOST_WINDOWS`` windows.

Decisions in a task follow the order of its rows, which a repeated table scan keeps.

Defined results: null or empty text has no words; a document without an id removes nothing and loses nothing; rows of
one doc_id do not remove from each other; where any has several rows, texts are told apart by a 64-bit hash too; repeated rows get one
result each; an empty table gives an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.store import materialize

#: Words of the grams that minimisers are taken from, frequent words whose grams come last, and windows of a string at most.
GRAM, COMMON, MOST_WINDOWS = 2, 4096, 64
#: Different strings under one minimiser beyond which its windows travel singly; and those of a task that are too few to report.
HOT, FEW = 1 << 16, 8
#: Words with a code of their own (some 12 MB with their hashes, whatever the corpus), and strings that a task remembers as copied.
CODES, REMEMBERED = 500_000, 100_000
#: Rows that are decided at once, and bits of a bucket's number: rows of several minimisers in a bucket do no harm.
CHUNK_ROWS, BUCKET_BITS = 1 << 16, 32


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : len(hashes) - k + 1 + i]
    return tx.mix(out + np.uint64(k))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted list."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def super_kmers(hashes: np.ndarray, bounds: np.ndarray, window: int, common: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and bucket of each stretch of windows that share a minimiser; windows of a hot one share their own hash.

    ``bounds`` has each document's first word; windows lie inside documents. ``common`` and ``hot`` are sorted.
    """
    n = len(hashes)
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    gram = min(GRAM, window)
    last = -sliding_least(-_among(hashes, common).astype(np.int8), gram) if gram > 1 else _among(hashes, common)
    key = sliding_least(_rolled(hashes, gram) >> np.uint64(1) | (last > 0).astype(np.uint64) << np.uint64(63), window - gram + 1)
    key = np.where(_among(key, hot), _rolled(hashes, window), key)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(place):
        return place, place, np.zeros(0, np.uint64)
    key = key[place]
    new = np.ones(len(place), bool)
    new[1:] = (key[1:] != key[:-1]) | (np.diff(place) != 1)
    since = np.arange(len(place)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero(new | (since % MOST_WINDOWS == 0))
    return place[first], np.diff(np.append(first, len(place))), key[first]


def _bytes(strings: pa.BinaryArray) -> np.ndarray:
    """The buffer behind strings, all of it."""
    raw = strings.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _words(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Hashes of a slice's words, each document's first, and the words themselves as numbers of a dictionary."""
    start, end, hashes, bounds = tx.words(part, offs)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return hashes, bounds, _binary(part[~tx.SPACE[part]], ends).dictionary_encode()


def codes(n: int) -> pa.BinaryArray:
    """The first n codes, short ones first: all but the last byte are below 0x80."""
    out: list[bytes] = []
    heads = [b""]
    while len(out) < n:
        out += [h + bytes([last]) for h in heads for last in range(0x80, 0x100)][: n - len(out)]
        heads = [h + bytes([more]) for h in heads for more in range(0x20, 0x80)] if len(out) < n else heads
    return pa.array(out, pa.binary())


class Lexicon:
    """Words with codes, looked up by hash and then compared, so that a word has its own code or none. Built once and sent to the tasks."""

    def __init__(self, table: pa.BinaryArray) -> None:
        self.table, self.codes = table, codes(len(table))
        hashes = self._hashes(table)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hashes(words: pa.BinaryArray) -> np.ndarray:
        return tx.words(*tx.doc_bytes(words.cast(pa.string(), safe=False)))[2]

    def first_hashes(self, n: int) -> np.ndarray:
        """Hashes of the n most frequent words."""
        return self._hashes(self.table.slice(0, n))

    def written(self, words: pa.BinaryArray) -> pa.BinaryArray:
        """The code of each word, or the word spelled."""
        spelled = pc.binary_join_element_wise(pa.scalar(b"\t", pa.binary()), words, pa.scalar(b"\n", pa.binary()), pa.scalar(b"", pa.binary()))
        if not len(self.table) or not len(words):
            return spelled
        place = pa.array(self.order[np.minimum(np.searchsorted(self.hashes, self._hashes(words)), len(self.order) - 1)])
        return pc.if_else(pc.equal(self.table.take(place), words), self.codes.take(place), spelled)

    def read(self, written: pa.BinaryArray) -> list[bytes]:
        """The words again."""
        offsets = np.frombuffer(written.buffers()[1], np.int32)[written.offset : written.offset + len(written) + 1].astype(np.int64)
        data, size = _bytes(written).astype(np.int64), np.diff(offsets)
        if not len(written):
            return []
        coded = data[offsets[:-1]] != 9
        place, below = np.zeros(len(written), np.int64), 0
        for length in range(1, int(size[coded].max(initial=0)) + 1):
            own = np.flatnonzero(coded & (size == length))
            value = np.zeros(len(own), np.int64)
            for k in range(length - 1):
                value = value * 96 + data[offsets[own] + k] - 0x20
            place[own] = below + value * 128 + data[offsets[own] + length - 1] - 0x80
            below += 128 * 96 ** (length - 1)
        known = self.table.take(pa.array(place)) if len(self.table) else written
        return pc.if_else(pa.array(coded), known, pc.binary_slice(written, 1, -1)).to_pylist()


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.BinaryArray:
    """Stretches of bytes, overlapping or not, one behind the other."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    return _binary(data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets)


def packed(words: pa.DictionaryArray, first: np.ndarray, count: np.ndarray, lexicon: Lexicon) -> pa.BinaryArray:
    """``count`` words from each ``first`` on, codes for known words, others spelled out."""
    tokens = lexicon.written(words.dictionary)
    if not len(tokens):
        return _binary(np.zeros(0, np.uint8), np.zeros(len(first) + 1))
    data, offsets = _bytes(tokens), np.frombuffer(tokens.buffers()[1], np.int32)[: len(tokens) + 1].astype(np.int64)
    number = words.indices.to_numpy()
    length = np.diff(offsets)[number]
    ends = np.zeros(len(number) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    stream = _bytes(_gathered(data, offsets[number], length))
    return _gathered(stream, ends[first], ends[first + count] - ends[first])


def unpacked(strings: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Numbers of the words of all strings, equal for equal words, each string's first, and how the words of the numbers are written."""
    rows = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = _bytes(strings)[rows[0] : rows[-1]]
    spelled = np.cumsum((data == 9).astype(np.int8) - (data == 10).astype(np.int8), dtype=np.int8)  # until the line feed
    ends = np.append(0, np.flatnonzero((data == 10) | ((data >= 0x80) & (spelled == 0))) + 1)
    words = _binary(data, ends).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), np.searchsorted(ends, rows - rows[0]), words.dictionary


def _short(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each number, lowest first, and how many of them say all."""
    used = np.zeros(len(values), np.int64)
    for k in range(width):
        used[(values >> np.uint64(8 * k)) > 0] = k + 1
    return values.view(np.uint8).reshape(len(values), 8)[:, :width], used


def _bodies(doc: np.ndarray, digest: np.ndarray, place: np.ndarray, strings: pa.BinaryArray, told: bool, wide: int) -> pa.BinaryArray:
    """Document and place in as few bytes as they need, and ``wide`` bytes of the digest, ahead of each string. The first byte has the two lengths, and whether the string is a count."""
    parts, lengths = zip(_short(doc.astype(np.int64).view(np.uint64), 8), _short(place.astype(np.uint64), 4), strict=True)
    head = (lengths[0] * 8 + lengths[1] + 128 * told).astype(np.uint8)[:, None]
    every = np.hstack([head, digest.astype(np.int64).view(np.uint8).reshape(len(doc), 8)[:, :wide], *parts])
    keep = np.hstack([np.ones((len(doc), 1 + wide), bool), *(np.arange(p.shape[1]) < n[:, None] for p, n in zip(parts, lengths, strict=True))])
    heads = _binary(every[keep], np.append(0, np.cumsum(keep.sum(axis=1))))
    return pc.binary_join_element_wise(heads, strings, pa.scalar(b"", pa.binary()))


def _opened(bodies: pa.BinaryArray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.BinaryArray]:
    """Of ``_bodies``: documents, digests, places, whether the string is a count, strings."""
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
    data = _bytes(bodies)
    start = offsets[:-1]
    head = data[start].astype(np.int64)
    n_doc, n_place = (head & 127) // 8, head & 7

    def number(begin: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        for k in range(width):
            there = np.flatnonzero(length > k)
            out[there] |= data[begin[there] + k].astype(np.uint64) << np.uint64(8 * k)
        return out.view(np.int64)

    digest = number(start + 1, np.full(len(start), wide), wide)
    own = start + 1 + wide
    doc, place = number(own, n_doc, 8), number(own + n_doc, n_place, 4)
    inner = own + n_doc + n_place
    return doc, digest, place, head >= 128, _gathered(data, inner, offsets[1:] - inner)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]


def same_windows(number: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """A number for the window at each place, equal for equal words: pairs of pairs are sorted and numbered."""
    have = 1
    while 2 * have <= window:
        number = _paired(number[:-have], number[have:])
        have *= 2
    return _paired(number[places], number[places + window - have])


def _spans(doc: np.ndarray, digest: np.ndarray, start: np.ndarray, windows: np.ndarray, window: int) -> pa.RecordBatch:
    """Spans of words: document, hash of the text, first word and the one behind the last."""
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(digest), pa.array(start), pa.array(start + windows + window - 1)], names=["doc_id", "digest", "start", "end"])


def _decided(rows: pa.Table, window: int, wide: int) -> pa.RecordBatch | None:
    """Of rows sorted by bucket, buckets whole: spans of the windows that a smaller document has too, and of those told before."""
    if not rows.num_rows:
        return None
    bucket = rows.column("bucket").to_numpy()
    doc, digest, place, told, strings = _opened(rows.column("body").combine_chunks(), wide)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    keep = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(doc)))) & ~told)
    known = None
    if told.any():
        count = np.frombuffer(strings.take(pa.array(np.flatnonzero(told))).buffers()[2], np.int64)
        known = _spans(doc[told], digest[told], place[told], count, window)
    if not len(keep):
        return known
    doc, digest, place = doc[keep], digest[keep], place[keep]
    number, bounds, _ = unpacked(strings.take(pa.array(keep)))
    windows = np.diff(bounds) - window + 1
    row = np.repeat(np.arange(len(doc)), windows)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    same = same_windows(number, bounds[row] + inner, window)
    least = np.full(same.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc[row])
    there = np.flatnonzero(least[same] < doc[row])
    if not len(there):
        return known
    new = np.append(True, (np.diff(there) != 1) | (row[there[1:]] != row[there[:-1]]))
    begin = there[new]
    count = np.diff(np.append(np.flatnonzero(new), len(there)))
    found = _spans(doc[row[begin]], digest[row[begin]], place[row[begin]] + inner[begin], count, window)
    return found if known is None else pa.concat_batches([known, found])


def _frequent(docs: DataFrame) -> pa.BinaryArray:
    """The most frequent words, frequent ones first: those from so high a count on that there are at most ``CODES``. Words that a task sees once are not counted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            data, offsets = tx.doc_bytes(batch.column(0))
            for i, j in tx.doc_slices(offsets):
                _, _, words = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                held.append(pa.table({"word": words.dictionary, "n": pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))}))
                if sum(x.num_rows for x in held) > 2_000_000:
                    held = [summed()]
                    if held[0].num_rows > 1_000_000:
                        rows = held.pop()
                        yield from rows.filter(pc.greater(rows["n"], 1)).to_batches(10_000)
        if held:
            rows = summed()
            yield from rows.filter(pc.greater(rows["n"], 1)).to_batches(10_000)

    counted = materialize(docs.select("text").mapInArrow(scan, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log("n") * 100)), "words")
    steps = sorted(counted.groupBy("step").count().collect(), reverse=True)  # counts in steps of a hundredth: a few thousand rows
    least = min((s for s, t in zip((r["step"] for r in steps), accumulate(r["count"] for r in steps), strict=True) if t <= CODES), default=None)
    words = counted.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "n").toArrow()
    return words.sort_by([("n", "descending"), ("word", "ascending")])["word"].combine_chunks()


def _hot(docs: DataFrame, window: int, common: np.ndarray) -> np.ndarray:
    """Minimisers of more than ``HOT`` different strings, or a millionth of all, sorted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, none = 0, np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            data, offsets = tx.doc_bytes(batch.column(0))
            for i, j in tx.doc_slices(offsets):
                _, _, hashes, bounds = tx.words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                first, count, bucket = super_kmers(hashes, bounds, window, common, none)
                if not len(first):
                    continue
                total += len(first)
                own = np.unique(tx.mix(bucket) ^ tx.mix(_rolled(hashes, window)[first] + count.astype(np.uint64)), return_index=True)[1]
                keys, n = np.unique(bucket[own], return_counts=True)
                held.append((keys[n > 1], n[n > 1]))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    keys, n = summed()
                    held = [(keys[n >= FEW], n[n >= FEW])]
        keys, n = summed() if held else (none, np.zeros(0, np.int64))
        some = n >= FEW
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys[some].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[some].tolist()], pa.int64())], names=["bucket", "n"])

    counted = materialize(docs.select("text").mapInArrow(scan, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    total = counted.where("bucket IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counted.where(F.col("bucket").isNotNull() & (F.col("n") > max(HOT, total // 1_000_000))).select("bucket").collect()
    return np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, digest and text of the rows, and the bytes that a digest takes: none (it is 0) while every doc_id has one row, else 8 of the text's hash."""
    own = docs.select(F.col("doc_id").cast("long"), "text")
    twins = own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return own.withColumn("digest", F.xxhash64("text") if twins else F.lit(0).cast("long")), 8 * twins


def shared_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, digest (as ``keyed`` gives it), start, end: stretches of words in windows that also start in a document of a smaller doc_id. They may overlap."""
    rows, wide = keyed(docs)
    return _spans_of(rows, wide, window, Lexicon(_frequent(rows)))


def _spans_of(docs: DataFrame, wide: int, window: int, lexicon: Lexicon) -> DataFrame:
    owned = docs.where("doc_id IS NOT NULL").select("doc_id", "digest", "text")
    common = np.sort(lexicon.first_hashes(COMMON))
    hot = _hot(owned, window, common)

    def row_batch(bucket: np.ndarray, bodies: pa.BinaryArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((bucket >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)), bodies], names=["bucket", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copied: dict[bytes, int] = {}
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = tx.doc_bytes(batch.column(2))
            for i, j in tx.doc_slices(offsets):
                hashes, bounds, words = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                first, count, bucket = super_kmers(hashes, bounds, window, common, hot)
                if not len(first):
                    continue
                doc = np.searchsorted(bounds, first, "right") - 1
                place, digest = first - bounds[doc], digests[i:j][doc]
                doc_id, strings = ids[i:j][doc], packed(words, first, count + window - 1, lexicon).dictionary_encode()
                number = strings.indices.to_numpy()
                least = np.full(len(strings.dictionary), np.iinfo(np.int64).max)
                np.minimum.at(least, number, doc_id)
                if copied:  # what the task has seen to be copied
                    seen = pc.index_in(strings.dictionary, value_set=pa.array(list(copied), pa.binary()))
                    met = np.flatnonzero(seen.is_valid().to_numpy(zero_copy_only=False))
                    values = np.fromiter(copied.values(), np.int64, len(copied))
                    least[met] = np.minimum(least[met], values[seen.take(pa.array(met)).to_numpy()])
                beaten = doc_id > least[number]
                if beaten.any():
                    for key in np.unique(number[beaten]):
                        string = strings.dictionary[int(key)].as_py()
                        if string in copied or len(copied) < REMEMBERED:
                            copied[string] = int(least[key])
                    lost = np.flatnonzero(beaten)  # neighbouring stretches become one span
                    new = np.append(True, (doc[lost[1:]] != doc[lost[:-1]]) | (first[lost[1:]] != first[lost[:-1]] + count[lost[:-1]]))
                    begin = lost[new]
                    windows = np.add.reduceat(count[lost], np.flatnonzero(new)).astype(np.int64)
                    counts = _binary(windows.view(np.uint8), np.arange(len(windows) + 1) * 8)
                    yield row_batch(tx.mix(tx.mix(doc_id[begin].view(np.uint64)) + place[begin].astype(np.uint64)), _bodies(doc_id[begin], digest[begin], place[begin], counts, True, wide))
                left = np.flatnonzero(~beaten)
                yield row_batch(bucket[left], _bodies(doc_id[left], digest[left], place[left], strings.dictionary.take(pa.array(number[left])), False, wide))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n, limit = 0, CHUNK_ROWS
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= limit:
                rows = pa.concat_tables(held)
                bucket = rows.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))
                if cut:
                    spans = _decided(rows.slice(0, cut), window, wide)
                    if spans is not None:
                        yield spans
                held, n = [rows.slice(cut)], len(rows) - cut
                limit = max(CHUNK_ROWS, 2 * n)  # a bucket larger than a chunk is looked at again when it has doubled
        if held:
            spans = _decided(pa.concat_tables(held), window, wide)
            if spans is not None:
                yield spans

    strings = owned.mapInArrow(cut, "bucket long, body binary")
    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, "doc_id long, digest long, start long, end long")


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) for every row of ``docs``."""
    rows, wide = keyed(docs)
    lexicon = Lexicon(_frequent(rows))
    spans = _spans_of(rows, wide, window, lexicon).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as its words alone, in codes: less to send than the text."""
        for batch in batches:
            data, offsets = tx.doc_bytes(batch.column(2))
            for i, j in tx.doc_slices(offsets):
                _, bounds, words = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), packed(words, bounds[:-1], np.diff(bounds), lexicon)], names=["doc_id", "digest", "words"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, ends = batch.column(2), batch.column(3)
            number, bounds, written = unpacked(batch.column(1))
            words = lexicon.read(written)
            removed, kept = [], []
            for k in range(batch.num_rows):
                own = number[bounds[k] : bounds[k + 1]]
                if starts[k].is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, starts[k].values.to_numpy(), 1)
                    np.add.at(edge, ends[k].values.to_numpy(), -1)
                    own = own[np.cumsum(edge[:-1]) == 0]
                removed.append(int(bounds[k + 1] - bounds[k]) - len(own))
                kept.append(b" ".join([words[w] for w in own.tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    coded_docs = rows.select("doc_id", "digest", "text").mapInArrow(pack, "doc_id long, digest long, words binary")
    joined = coded_docs.join(spans, ["doc_id", "digest"], "left").select("doc_id", "words", F.col("spans.start").alias("start"), F.col("spans.end").alias("end"))
    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
