"""Operator 2, WARC archives with a Merkle fixity audit of their replicas.

Writing: each task streams its pages into archive files of compressed records, one copy under each
replica's folder, under a name of its own; only the files that finished tasks report belong to the
archive, so lost or repeated tasks leave nothing wrong. The index holds file, ordinal, offset and length
of every record.

Audit: stored bytes of each replica are hashed by index range. A leaf is the digest of one record; a
node above covers ``FAN_OUT`` neighbours of its file and holds the digest of their digests and their
ordered offset ranges; a file's top node is its root. The replicas' roots are compared first, and
only the children of nodes that differ are compared on the next level, so a sound file costs one
comparison, and a damaged record costs ``FAN_OUT`` for each level. A group is at most ``FAN_OUT`` rows, whatever the
file's length, and stretches of one file are hashed in different tasks.

Defined results: null or empty html is a record without content; a null page_id or url leaves its header
out; repeated rows are records of their own; a lost or shortened replica file damages the records that
it no longer holds; an empty table has no files; only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import materialize, shared_dir

FAN_OUT = 16
FILE_BYTES = 1 << 28
#: Records that one task hashes in a row; a longer file is cut.
STRETCH = 4096
READ_BYTES = 1 << 22
_INDEX = "page_id long, file string, ordinal long, offset long, length long"

#: (digest of the record's content, its stored bytes) -> the bytes that a replica stores.
Fault = Callable[[bytes, bytes], bytes]


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC resource record."""
    body = (html or "").encode()
    head = ["WARC/1.1", "WARC-Type: resource"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def stored(raw: bytes) -> bytes:
    """A record as a gzip member of its own, so that it can be read by its offset."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of a stored record."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, folders: Sequence[str], faults: Sequence[Fault | None] | None = None) -> DataFrame:
    """Write the same files under every folder; the index: page_id, file, ordinal, offset, length."""
    changes = faults or [None] * len(folders)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, streams, name, rows, at = TaskContext.get().partitionId(), [], "", [], 0

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "file", "ordinal", "offset", "length"])
            rows.clear()
            return out

        ordinal = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    if at >= FILE_BYTES:
                        for stream in streams:
                            stream.close()
                        streams = []
                    if not streams:
                        name, at, ordinal = f"{task:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        for folder in folders:
                            store, root = fs.FileSystem.from_uri(folder)
                            store.create_dir(root, recursive=True)
                            streams.append(store.open_output_stream(f"{root}/{name}", compression=None))
                    raw = record(page_id, url, html)
                    member, digest = stored(raw), hashlib.sha256(raw).digest()
                    for stream, change in zip(streams, changes, strict=True):
                        stream.write(change(digest, member) if change else member)
                    rows.append((page_id, name, ordinal, at, len(member)))
                    at, ordinal = at + len(member), ordinal + 1
                yield batch_of()
        for stream in streams:
            stream.close()

    return materialize(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, _INDEX), "warc-index")


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """Level 0 of the tree: file, node, digest (null where the replica lacks the bytes), first, end."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source, size, begin, held = None, None, 0, 0, b""
        for batch in batches:
            digests = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.select([0, 2, 3]).columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, begin, held = file, 0, b""
                    found = store.get_file_info(f"{root}/{file}")
                    source = store.open_input_file(found.path) if found.type == fs.FileType.File else None
                    size = found.size or 0
                if source is None or offset + length > size:
                    digests.append(None)
                    continue
                if not begin <= offset <= offset + length <= begin + len(held):
                    source.seek(offset)
                    begin, held = offset, source.read(max(length, READ_BYTES))
                digests.append(hashlib.sha256(held[offset - begin : offset - begin + length]).digest())
            end = pa.array([o + n for o, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), batch.column(2), end], names=["file", "node", "digest", "first", "end"])
        if source is not None:
            source.close()

    dealt = index.select("file", "ordinal", "offset", "length").repartition("file", F.floor(F.col("ordinal") / STRETCH)).sortWithinPartitions("file", "ordinal")
    return dealt.mapInArrow(read, "file string, node long, digest binary, first long, end long")


def tree(level0: DataFrame) -> list[DataFrame]:
    """All levels, leaves first, until every file has one node."""
    levels = [materialize(level0, "warc-level")]
    while levels[-1].where("node > 0").limit(1).count():
        kids = F.array_sort(F.collect_list(F.struct("node", F.coalesce("digest", F.lit(b"")).alias("digest"), "first", "end")))
        up = levels[-1].groupBy("file", F.floor(F.col("node") / FAN_OUT).alias("node")).agg(kids.alias("kids"), F.min("first").alias("first"), F.max("end").alias("end"))
        written = F.concat_ws(",", F.transform("kids", lambda k: F.concat_ws(":", F.hex(k["digest"]), k["first"].cast("string"), k["end"].cast("string"))))
        levels.append(materialize(up.select("file", "node", F.unhex(F.sha2(written, 256)).alias("digest"), "first", "end"), "warc-level"))
    return levels


def differing_leaves(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, node) of the leaves in which two trees over one index differ, from the roots down."""

    def differ(level: int, of: DataFrame) -> DataFrame:
        other = theirs[level].select("file", "node", F.col("digest").alias("other"))
        return of.join(other, ["file", "node"], "left").where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "node")

    top = len(ours) - 1
    at = differ(top, ours[top])
    for level in range(top - 1, -1, -1):
        at = materialize(at.withColumnRenamed("node", "above"), "warc-differ")
        below = ours[level].withColumn("above", F.floor(F.col("node") / FAN_OUT)).join(at, ["file", "above"], "left_semi")
        at = differ(level, below)
    return at


def audit(index: DataFrame, folders: tuple[str, str]) -> DataFrame:
    """page_id, file, ordinal, offset, length, sha256 (of the first replica's bytes), intact: one row a record."""
    ours, theirs = (tree(leaves(index, folder)) for folder in folders)
    bad = differing_leaves(ours, theirs).select("file", F.col("node").alias("ordinal"), F.lit(False).alias("same"))
    digests = ours[0].select("file", F.col("node").alias("ordinal"), F.lower(F.hex("digest")).alias("sha256"))
    return index.join(digests, ["file", "ordinal"]).join(bad, ["file", "ordinal"], "left").select("page_id", "file", "ordinal", "offset", "length", "sha256", F.coalesce("same", F.lit(True)).alias("intact"))


def flip_some(digest: bytes, member: bytes) -> bytes:
    """A planted fault: one byte of every record whose content digest begins with a zero byte."""
    if digest[0]:
        return member
    at = len(member) // 2
    return member[:at] + bytes([member[at] ^ 1]) + member[at + 1 :]


def archived_and_audited(pages: DataFrame, fault: Fault | None = flip_some) -> DataFrame:
    """Archive the pages twice, with a planted fault in the second replica, and audit one against the other."""
    top = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folders = (f"{top}/a", f"{top}/b")
    return audit(write_archives(pages, folders, (None, fault)), folders)
