"""Operator 10, token-id files of patched frame-of-reference blocks.

File format, little-endian. Header: magic ``SPFR``, format 1, block size (u32 each). Blocks of ids in
order: minimum u32, count u16, exceptions u16, width u8, then the ids less the minimum at ``width`` bits
each, then the exceptions' positions (u16) and values less the minimum (u32). Footer: block starts
(u64), document ids (i64), their null marks (u8) and lengths (u32); then the counts of blocks and of
documents, the footer's place (u64 each) and the magic again. ``width`` is that of the percentile of
``PERCENTILES`` that makes the block smallest; larger values are exceptions, with their low bits packed.

Writing: documents are dealt into ranges of doc_id, sorted, and each task streams one file into the
shared folder under a name of its own; only files that a finished task reports are part of the data
set, so lost or repeated tasks leave nothing wrong. A task holds one block run and its documents'
lengths, never all ids. The driver sees one row a file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from struct import calcsize, pack, unpack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.encoders import worker_encoder
from spanloom.llm.store import materialize, shared_dir

MAGIC, BLOCK = b"SPFR", 1024
PERCENTILES = (0.9, 0.95, 0.99, 1.0)
RUN = 256  # blocks that are packed at once
_HEAD = "<IHHB"
SLICE_BYTES = 1 << 22


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids each; the last may be short."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    if whole:
        out += _pack_matrix(ids[:whole].reshape(-1, BLOCK))
    if whole < len(ids):
        out += _pack_matrix(ids[whole:].reshape(1, -1))
    return out


def _pack_matrix(ids: np.ndarray) -> list[bytes]:
    rows, n = ids.shape
    low = ids.min(axis=1)
    rest = (ids - low[:, None]).astype("<u4")
    ordered = np.sort(rest, axis=1)
    best_width, best_size = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        width = _bit_length(ordered[:, min(n - 1, int(np.ceil(p * n)) - 1)])
        outside = (rest >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0).sum(axis=1) * (width < 32)
        size = width * n + 48 * outside
        best_width, best_size = np.where(size < best_size, width, best_width), np.minimum(size, best_size)
    out: list[bytes] = [b""] * rows
    for width in np.unique(best_width):
        which = np.flatnonzero(best_width == width)
        values = rest[which]
        low_bytes = values.view(np.uint8).reshape(len(which), n, 4)[:, :, : -(-width // 8)]
        bits = np.unpackbits(low_bytes, axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        over = values >> np.uint32(min(width, 31)) > 0 if width < 32 else np.zeros(values.shape, bool)
        for k, row in enumerate(which):
            at = np.flatnonzero(over[k])
            out[row] = pack(_HEAD, int(low[row]), n, len(at), int(width)) + packed[k].tobytes() + at.astype("<u2").tobytes() + values[k, at].tobytes()
    return out


def unpack_block(raw: bytes, start: int = 0) -> tuple[np.ndarray, int]:
    """Ids of the block at ``start``, and where the next begins."""
    low, n, exceptions, width = unpack(_HEAD, raw[start : start + calcsize(_HEAD)])
    at = start + calcsize(_HEAD)
    size = (n * width + 7) // 8
    values, n_bytes = np.zeros((n, 4), np.uint8), -(-width // 8)
    if width:
        bits = np.zeros((n, 8 * n_bytes), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        values[:, :n_bytes] = np.packbits(bits.reshape(-1), bitorder="little").reshape(n, n_bytes)
    ids = values.view("<u4").reshape(-1)
    at += size
    ids[np.frombuffer(raw, "<u2", exceptions, at)] = np.frombuffer(raw, "<u4", exceptions, at + 2 * exceptions)
    return ids + np.uint32(low), at + 6 * exceptions


class FileWriter:
    """Streams documents into one file."""

    def __init__(self, stream):
        self.stream, self.place, self.starts = stream, 0, []
        self.ids: list[np.ndarray] = []
        self.waiting = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC + pack("<II", 1, BLOCK))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.place += len(raw)

    def _blocks(self, ids: np.ndarray) -> None:
        for block in pack_blocks(ids):
            self.starts.append(self.place)
            self._put(block)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= RUN * BLOCK:
            flat = np.concatenate(self.ids)
            cut = len(flat) // BLOCK * BLOCK
            for k in range(0, cut, RUN * BLOCK):
                self._blocks(flat[k : min(k + RUN * BLOCK, cut)])
            self.ids, self.waiting = [flat[cut:]], len(flat) - cut

    def close(self) -> None:
        if self.waiting:
            self._blocks(np.concatenate(self.ids))
        footer = self.place
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes() + np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self._put(np.array(self.lengths, "<u4").tobytes())
        self._put(pack("<QQQ", len(self.starts), len(self.doc_ids), footer) + MAGIC)
        self.stream.close()


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of an open random-access file, in order; a run of blocks is in memory at a time."""
    size = source.size()
    source.seek(size - 28)
    blocks, docs, footer = unpack("<QQQ", source.read(24))
    if source.read(4) != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(footer)
    starts = np.append(np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64), footer)
    doc_ids, absent = np.frombuffer(source.read(8 * docs), "<i8"), np.frombuffer(source.read(docs), np.uint8)
    lengths = np.frombuffer(source.read(4 * docs), "<u4")
    have, block = np.zeros(0, "<u4"), 0
    for doc_id, none, n in zip(doc_ids.tolist(), absent.tolist(), lengths.tolist(), strict=True):
        if len(have) < n:
            parts, held = [have], len(have)
            while held < n:
                stop = min(block + RUN, blocks)
                source.seek(int(starts[block]))
                raw = source.read(int(starts[stop] - starts[block]))
                for k in range(block, stop):
                    parts.append(unpack_block(raw, int(starts[k] - starts[block]))[0])
                    held += len(parts[-1])
                block = stop
            have = np.concatenate(parts)
        yield (None if none else doc_id), have[:n]
        have = have[n:]


def write_ids(docs: DataFrame, folder: str, vocabulary: str, keep_space: bool = True, end_id: int = 2) -> DataFrame:
    """Write the documents' ids in ascending doc_id; one row a file: part, path, n_docs, n_ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            encoder = worker_encoder(vocabulary, keep_space)
            end = np.array([end_id], "<u4")
            _, offsets = tx.doc_bytes(batch.column(1))
            for i, j in tx.doc_slices(offsets, SLICE_BYTES):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.spfr"
                    writer = FileWriter(store.open_output_stream(f"{root}/{name}"))
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                for doc_id, raw in zip(batch.column(0).slice(i, j - i).to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.concatenate([np.frombuffer(raw, encoder.dtype).astype("<u4"), end])
                    writer.add(doc_id, ids)
                    total += len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.lengths)], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    spark = manifest.sparkSession
    files, start = [], 0
    for row in manifest.orderBy("part").collect():  # one row a file
        files.append((row["path"], start))
        start += row["n_ids"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as source:
                    rows: list[tuple] = []
                    for doc_id, ids in read_file(source):
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    listed = spark.createDataFrame(files, "path string, base long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, ", ".join(f"{c} long" for c in names))


def token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Write all documents' ids (end id 2) to files in the shared folder and read them back.

    Defined results: null or empty text is the end id alone; a null doc_id sorts first; rows of one
    doc_id follow each other in an order fixed by their text; an empty table gives no rows.
    """
    folder = f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(docs, folder, vocabulary))
