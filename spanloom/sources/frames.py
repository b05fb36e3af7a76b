"""Binary audio streams as tables of tiles: one row a frame, and one for each stretch between frames. Nothing is decoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of MPEG audio: kbit/s by index for (version 1, layers III, II, I; version 2 layers III and II, I), Hz by version, samples a frame.
KBPS = {
    (3, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (2, 1): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(3, 1): 1152, (3, 2): 1152, (3, 3): 384, (2, 1): 576, (2, 2): 1152, (2, 3): 384}
#: Shorter frames are no frames.
SHORTEST = 24


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Frame length and seconds by the 15 bits of a header that tell them: version, layer, rates and padding (0 where there is no frame)."""
    length, seconds = np.zeros(1 << 10, np.int64), np.zeros(1 << 10)
    for code in range(1 << 10):
        version, layer, rate, hertz, padding = code >> 8, code >> 6 & 3, code >> 2 & 15, code & 3, 0
        if version == 1 or layer == 0 or rate in (0, 15) or hertz == 3:
            continue
        family = 3 if version == 3 else 2
        kbps = KBPS[family, layer] if family == 3 else KBPS[(2, 1) if layer < 3 else (3, 3)]
        if family == 2 and layer == 2:
            kbps = KBPS[3, 2]
        samples, hz = SAMPLES[family, layer], HERTZ[version][hertz]
        # a slot is four bytes in layer I, one elsewhere
        length[code] = 12000 * kbps[rate] // hz * 4 if layer == 3 else samples * 125 * kbps[rate] // hz
        seconds[code] = samples / hz
    return length, seconds


_LENGTH, _SECONDS = _tables()


def headers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all four bytes that are a frame header, and the frames' lengths."""
    at = np.flatnonzero(data[:-3] == 0xFF) if len(data) >= 4 else np.zeros(0, np.int64)
    at = at[(data[at + 1] & 0xE0) == 0xE0]
    second, third = data[at + 1].astype(np.int64), data[at + 2].astype(np.int64)
    layer = second >> 1 & 3
    length = _LENGTH[(second >> 3 & 3) << 8 | layer << 6 | third >> 4 << 2 | third >> 2 & 3]
    length = np.where(length > 0, length + (third >> 1 & 1) * np.where(layer == 3, 4, 1), 0)
    return at[length >= SHORTEST], length[length >= SHORTEST]


def tag_length(raw: bytes, at: int) -> int:
    """Bytes of the ID3v2 tag that begins at a place; 0 if none does."""
    head = raw[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or any(b & 0x80 for b in head[6:]):
        return 0
    return 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + (10 if head[5] & 0x10 else 0)


def tiles(raw: bytes) -> list[tuple[int, int, bool, float, float]]:
    """(offset, length, is_frame, at, seconds) of stretches that cover a file.

    Frames follow one another. Where none does, a tag is skipped whole; a trailer of 128 bytes ends the walk; else it goes on
    at the next header behind whose frame another header or the end stands. A cut-off last frame is no frame.
    """
    data, size = np.frombuffer(raw, np.uint8), len(raw)
    places, lengths = headers(data)
    length_at = dict(zip(places.tolist(), lengths.tolist(), strict=True))
    ends = places + lengths
    # places are in order
    follows = (ends + 4 > size) | (np.append(places, -1)[np.searchsorted(places, ends)] == ends)
    starts = places[follows]
    out: list[tuple[int, int, bool, float, float]] = []
    pos, since, at = tag_length(raw, 0), 0, 0.0

    def other(until: int) -> None:
        if until > since:
            out.append((since, until - since, False, at, 0.0))

    while pos + 4 <= size:
        length = length_at.get(pos)
        if length is None:
            tag = tag_length(raw, pos)
            if tag and pos + tag <= size:
                pos += tag
                continue
            if size - pos == 128 and raw[pos : pos + 3] == b"TAG":
                break
            k = int(np.searchsorted(starts, pos + 1))
            if k == len(starts):
                break
            pos = int(starts[k])
            continue
        if pos + length > size:
            break
        other(pos)
        code = (raw[pos + 1] >> 3 & 3) << 8 | (raw[pos + 1] >> 1 & 3) << 6 | raw[pos + 2] >> 4 << 2 | raw[pos + 2] >> 2 & 3
        out.append((pos, length, True, at, float(_SECONDS[code])))
        at += float(_SECONDS[code])
        pos += length
        since = pos
    other(size)
    return out


TILE = "offset long, length long, is_frame boolean, at double, seconds double, digest long, bytes binary, leading long, size long"
TILE_TYPES = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
#: Tiles, and bytes of them, that go out at once.
BATCH_TILES, BATCH_BYTES = 20_000, 8_000_000


def read_tiles(files: DataFrame, keys: list[str], key_types: str, content: str = "content") -> DataFrame:
    """Rows with a file's bytes to its tiles: keys, offset, length, is_frame, at and seconds, a digest of the bytes, the bytes, the leading tag's length and the file's size.

    A file is one row and has to fit a task; a null or empty one gives nothing.
    """
    names = [f.split()[0] for f in TILE.split(", ")]

    def packed(rows: list[tuple], own: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*own, *TILE_TYPES], strict=True)], names=[*keys, *names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tiles of many files go out together: a batch for each of many small files costs more than its tiles
        held: list[tuple] = []
        size = 0
        for batch in batches:
            own = batch.schema.types[: len(keys)]
            for k in range(batch.num_rows):
                raw = batch.column(len(keys))[k].as_py() or b""
                key = [batch.column(c)[k].as_py() for c in range(len(keys))]
                lead = min(tag_length(raw, 0), len(raw))
                for tile in tiles(raw):
                    piece = raw[tile[0] : tile[0] + tile[1]]
                    held.append((*key, *tile, int.from_bytes(hashlib.sha256(piece).digest()[:8], "little", signed=True), piece, lead, len(raw)))
                    size += len(piece)
                    if len(held) == BATCH_TILES or size >= BATCH_BYTES:
                        yield packed(held, own)
                        held, size = [], 0
        if held:
            yield packed(held, own)

    return files.select(*keys, F.col(content)).mapInArrow(walk, f"{key_types}, {TILE}")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tiles of all files under the paths, by ``path``."""
    return read_tiles(spark.read.format("binaryFile").load(paths), ["path"], "path string")
