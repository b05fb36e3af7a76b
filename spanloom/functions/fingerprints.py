"""Column functions on signatures and sequences, in Arrow batches with numpy."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, the steps of the family of hashes, its size, and the seed of the bit weights.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
STEP_A, STEP_B, HASHES = 0x517CC1B727220A95, 0x6C62272E07BB0142, 128
WEIGHT_SEED = 0xC0FFEEBEEF


def _fnv(texts: list[str]) -> np.ndarray:
    """FNV-1a of each text's UTF-8 bytes: one pass over byte columns."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(r.ljust(int(size.max(initial=0)), b"\0") for r in raw), np.uint8).reshape(len(raw), -1)
    out = np.full(len(raw), FNV_OFFSET, np.uint64)
    for k in range(flat.shape[1]):
        out = np.where(k < size, (out ^ flat[:, k]) * np.uint64(FNV_PRIME), out)
    return out


def stable_hash(text: Column) -> Column:
    """FNV-1a as a signed long; null for null and empty texts."""

    @F.arrow_udf("long")
    def hashed(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        known = [t for t in texts if t]
        values = iter(_fnv(known).view(np.int64).tolist() if known else [])
        return pa.array([next(values) if t else None for t in texts], pa.int64())

    return hashed(text)


def minhash(grams: Column) -> Column:
    """128 unsigned minima of an array of texts' hashes, as signed longs; all ones for no texts, null for null. Nulls within the array are left out."""
    a, b = (np.arange(HASHES, dtype=np.uint64) * np.uint64(step) for step in (STEP_A, STEP_B))

    @F.arrow_udf("array<long>")
    def signature(column: pa.Array) -> pa.Array:
        out = []
        for texts in column.to_pylist():
            least = np.full(HASHES, 2**64 - 1, np.uint64)
            texts = texts and [t for t in texts if t is not None]
            for k in range(0, len(texts or ()), 4096):
                part = _fnv(texts[k : k + 4096])
                least = np.minimum(least, ((part[:, None] + a) ^ b).min(axis=0))
            out.append(None if texts is None else least.view(np.int64).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return signature(grams)


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of places at which two signatures are equal; 0 for signatures of different sizes."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def encode_signature(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def decode_signature(written: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(0), (F.length(written) / 16).cast("int") - 1), lambda i: F.substring(written, i * 16 + 1, F.lit(16)))
    half = lambda x, at: F.conv(F.substring(x, at, F.lit(8)), 16, 10).cast("long")
    return F.transform(parts, lambda x: F.shiftleft(half(x, F.lit(1)), 32).bitwiseOR(half(x, F.lit(9))))


def simhash(frames: Column) -> Column:
    """64 bits, each the sign of the weighted bits of all 32-bit frames; the first output bit is the lowest. Nulls within the array are left out."""
    rng = random.Random(WEIGHT_SEED)
    weights = np.array([[1 if rng.random() >= 0.5 else -1 for _ in range(64)] for _ in range(32)])

    @F.arrow_udf("long")
    def bits(column: pa.Array) -> pa.Array:
        out = []
        for values in column.to_pylist():
            if values is None:
                out.append(None)
                continue
            frame = np.array([v for v in values if v is not None], np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            signs = ((frame[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
            votes = signs.sum(axis=0) @ weights
            out.append(int(np.packbits((votes > 0)[::-1]).view(">i8")[0]))
        return pa.array(out, pa.int64())

    return bits(frames)


def _local_score(a: list[str], b: list[str], match: int, mismatch: int, gap: int) -> int:
    """Best local alignment: the rows of the table, with runs of gaps in a row settled by a running maximum."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s], np.int64) for s in (a, b))
    if len(x) < len(y):
        x, y = y, x
    ramp = np.arange(len(y) + 1) * gap
    row, best = np.zeros(len(y) + 1, np.int64), 0
    for token in x:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(y == token, match, -mismatch), row[1:] - gap), 0)
        row = np.maximum.accumulate(new + ramp) - ramp
        best = max(best, int(row.max()))
    return best


def alignment(a: Column, b: Column, match: int = 2, mismatch: int = 1, gap: int = 1) -> Column:
    """Local alignment of two arrays of words, by the best that the shorter one could reach (0 to 1)."""

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([min(1.0, _local_score(x, y, match, mismatch, gap) / (match * min(len(x), len(y)))) if x and y else 0.0 for x, y in pairs], pa.float64())

    return score(a, b)


def correlation_peak(template: Column, target: Column) -> Column:
    """Where a template correlates best with a longer series: struct of offset (the first of equal ones) and peak; null if it can't."""

    @F.arrow_udf("struct<offset:int,peak:double>")
    def peak(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for t, x in zip(left.to_pylist(), right.to_pylist(), strict=True):
            t, x = np.array(t or [], float), np.array(x or [], float)
            centered = t - t.mean() if len(t) else t
            norm = np.sqrt((centered**2).sum())
            if not len(t) or len(x) < len(t) or norm == 0:
                out.append(None)
                continue
            n = len(t)
            sums, squares = (np.diff(np.concatenate([[0.0], np.cumsum(v)])[[np.arange(len(x) - n + 1), np.arange(len(x) - n + 1) + n]], axis=0)[0] for v in (x, x**2))
            curve = np.correlate(x, centered, "valid") / (np.sqrt(np.maximum(squares - sums**2 / n, 1e-12)) * norm)
            out.append({"offset": int(curve.argmax()), "peak": float(curve.max())})
        return pa.array(out, pa.struct([("offset", pa.int32()), ("peak", pa.float64())]))

    return peak(template, target)


# ---- two recordings of one thing


def _runs(a: np.ndarray, b: np.ndarray, tolerance: int, least: int) -> list[tuple[int, int, int]]:
    """Aligned stretches (start in a, start in b, length): from each yet uncovered frame of b that a has too, the longest one."""
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    covered, i, out = -1, 0, []
    while i < len(b):
        lo, hi = np.searchsorted(ordered, b[i], "left"), np.searchsorted(ordered, b[i], "right")
        best = None
        for at in order[lo:hi].tolist():
            ahead = np.bitwise_count(a[at:][: len(b) - i] ^ b[i:][: len(a) - at]) > tolerance
            forward = int(ahead.argmax()) if ahead.any() else len(ahead)
            room = min(at, i - covered - 1)
            behind = np.bitwise_count(a[at - room : at] ^ b[i - room : i])[::-1] > tolerance
            back = int(behind.argmax()) if behind.any() else room
            if forward + back >= least and (best is None or forward + back > best[2]):
                best = (at - back, i - back, forward + back)
        if best:
            out.append(best)
            covered = best[1] + best[2] - 1
            i = covered
        i += 1
    return out


def _joined(runs: list[tuple[int, int, int]], slack: int) -> list[tuple[int, int, int]]:
    """Runs of nearly one diagonal, behind each other in both, as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(runs, key=lambda r: r[1]):
        if out:
            pa_, pb, pn = out[-1]
            gap_a, gap_b = a - pa_ - pn, b - pb - pn
            if abs((pa_ - pb) - (a - b)) <= slack and gap_a >= 0 and gap_b >= 0 and abs(gap_a - gap_b) <= slack:
                out[-1] = (pa_, pb, b + n - pb)
                continue
        out.append((a, b, n))
    return out


def _gaps(spans: list[tuple[int, int]], total: int, least: int) -> list[tuple[int, int, int, int]]:
    """What spans leave uncovered: start, end, and the lengths of the spans on either side."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    edges = [(0, 0), *map(tuple, merged), (total, total)]
    return [(e0, s1, e0 - s0, e1 - s1) for (s0, e0), (s1, e1) in zip(edges, edges[1:], strict=False) if s1 - e0 >= least]


_SLOTS = "array<struct<side:string,start:int,end:int,left:int,right:int>>"


def differences(a: Column, b: Column, tolerance: int = 2, least_run: int = 8, slack: int = 2, least_gap: int = 5) -> Column:
    """Stretches of either of two sequences of 32-bit frames that the other lacks: array of (side, start, end, left, right), the last two the aligned lengths beside it.

    Null is an empty sequence; a null within one gives null, as places behind it would be none.
    """

    @F.arrow_udf(_SLOTS)
    def slots(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if None in (x or ()) or None in (y or ()):
                out.append(None)
                continue
            fa, fb = (np.array(v or [], np.int64).astype(np.uint32) for v in (x, y))
            runs = _joined(_runs(fa, fb, tolerance, least_run), slack)
            sides = (("a", [(r[0], r[0] + r[2]) for r in runs], len(fa)), ("b", [(r[1], r[1] + r[2]) for r in runs], len(fb)))
            out.append([dict(zip(("side", "start", "end", "left", "right"), (side, *g), strict=True)) for side, spans, total in sides for g in _gaps(spans, total, least_gap)])
        kind = pa.list_(pa.struct([("side", pa.string()), *((c, pa.int32()) for c in ("start", "end", "left", "right"))]))
        return pa.array(out, kind)

    return slots(a, b)
