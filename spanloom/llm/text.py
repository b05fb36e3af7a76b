"""Vectorised words over Arrow string columns: byte buffers in, word offsets and 64-bit word hashes out.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. They are found on UTF-8 bytes, where those separators
are single bytes, so nothing is decoded. Work goes on in slices of a few MB of text whatever the
size of the Arrow batch; a document longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE = _splitmix(256, 11)
_BYTE_LOWER = _BYTE[_LOWER]
_R, _R_INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of R and of its inverse modulo 2**64, as far as the longest chunk so far."""
    if not _powers or len(_powers["r"]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for key, base in (("r", _R), ("inv", _R_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["r"], _powers["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place-free fashion."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def doc_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: each word's start, end (exclusive), 64-bit hash, and each document's first word (n + 1 numbers)."""
    table = _BYTE_LOWER if lower else _BYTE
    starts, ends, hashes = [], [], []
    pos, n = 0, len(data)
    offsets = offsets - offsets[0]
    while pos < n:
        stop = min(pos + CHUNK_BYTES, n)
        while stop < n and not SPACE[data[stop - 1]]:  # cut behind a separator or between documents
            ahead = np.flatnonzero(SPACE[data[stop - 1 : stop + 4096]])
            at = stop - 1 + int(ahead[0]) + 1 if len(ahead) else min(stop + 4096, n)
            edge = int(np.searchsorted(offsets, stop, "left"))
            nxt = int(offsets[edge]) if edge < len(offsets) else n
            if nxt <= at:
                stop = nxt
                break
            stop = at
        part = data[pos:stop]
        solid = ~SPACE[part]
        first = np.ones(len(part) + 1, bool)
        first[1:-1] = ~solid[:-1]
        inside = offsets[(offsets >= pos) & (offsets < stop)] - pos
        first[inside] = True
        s = np.flatnonzero(solid & first[:-1])
        after = np.ones(len(part), bool)
        after[:-1] = ~solid[1:] | first[1:-1]
        e = np.flatnonzero(solid & after) + 1
        if len(s):
            r, inv = _power_tables(len(part) + 1)
            c = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * r[: len(part)], out=c[1:])
            h = (c[e] - c[s]) * inv[s]
            hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            starts.append(s + pos)
            ends.append(e + pos)
        pos = stop
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets, "left")


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs inside documents, and each document's first (n + 1 numbers).

    A document of one to k - 1 words has its whole sequence as its only shingle.
    """
    count = np.diff(bounds)
    n_docs = len(count)
    runs = np.maximum(count - k + 1, np.minimum(count, 1))
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(runs, out=first[1:])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    if len(hashes) < k:
        hashes = np.concatenate([hashes, np.zeros(k, np.uint64)])
    rolled = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : len(hashes) - k + 1 + i]
    rolled = mix(rolled + np.uint64(k))
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], runs)
    out = rolled[np.minimum(at, len(rolled) - 1)]
    for d in np.flatnonzero((count > 0) & (count < k)):  # shorter than a shingle
        h = np.array([count[d]], np.uint64)
        for w in range(bounds[d], bounds[d] + count[d]):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[w : w + 1]
        out[first[d]] = mix(h)[0]
    return out, first


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists over flat values."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
