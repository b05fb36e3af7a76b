"""Two byte streams against each other: what they share, in order, and the slots between.

Streams are tables of tiles (``sources.frames``) that cover them. Frames whose bytes are there once on either side are anchors;
at the distance of an anchor, neighbouring tiles that are equal too make it a run; the heaviest chain of runs that
go forward on both sides is what is common. All joins are equi-joins by pair and digest, or by pair and offset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from spanloom.operators.segments import _fold
from spanloom.storage import written

#: Runs of fewer bytes are taken for chance.
LEAST_BYTES = 65_536
#: Bytes of a block of offsets; no tile that is looked up in is found in more than its blocks.
BLOCK = 1 << 16
#: Bits of the map of places whose tiles are sent on: 16 MB.
BITMAP_BITS = 1 << 27


@F.arrow_udf(IntegerType())
def _common_prefix(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of first bytes that are equal; 0 for null."""
    out = np.zeros(len(a), np.int32)
    for k, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
        if x and y:
            n = min(len(x), len(y))
            unlike = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
            out[k] = unlike[0] if len(unlike) else n
    return pa.array(out)


def _only(side: DataFrame, points: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """The rows of a side that may stand at one of the points (keys, place): by a bitmap of their hashes, so that the others' bytes are not sent on. A few more may come along, none is missing."""
    at = F.pmod(F.xxhash64(*keys, place), F.lit(BITMAP_BITS))
    placed = lambda rows: rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)})
    bitmap = placed(points.select(*keys, place)).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    # BITMAP_BITS / 32768 rows of 4 KB at most
    return placed(side).join(F.broadcast(bitmap), "_bucket").where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*side.columns)


def anchors(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames whose digest stands once in a and once in b: keys, a_off, b_off, length. Counted in one aggregation, so a frequent digest is summed up and never paired."""
    sides = a.where("is_frame").select(*keys, "digest", "offset", "length", F.lit(0).alias("side")).unionByName(b.where("is_frame").select(*keys, "digest", "offset", "length", F.lit(1).alias("side")))
    of = lambda side, f, c: f(F.when(F.col("side") == side, F.col(c)))
    each = sides.groupBy(*keys, "digest").agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"), of(0, F.min, "offset").alias("a_off"), of(1, F.min, "offset").alias("b_off"), F.min("length").alias("length"))
    return each.where("n_a = 1 AND n_b = 1").select(*keys, "a_off", "b_off", "length")


def runs(a: DataFrame, b: DataFrame, keys: Sequence[str], least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Stretches of equal bytes around anchors: keys, a_start, b_start, bytes.

    A stretch is made of tiles that are equal at one distance, and of the bytes that the tiles on its two ends share.
    Tiles of a are looked up once for each distance at which the pair has an anchor: few, where one is an edit of the other.
    """
    found = written(anchors(a, b, keys).select(*keys, (F.col("a_off") - F.col("b_off")).alias("delta"), F.col("a_off").alias("offset")), "anchors")
    deltas = found.select(*keys, "delta").distinct()
    tile = ["offset", "length", "digest"]
    moved = a.select(*keys, *tile).join(deltas, list(keys)).withColumn("b_off", F.col("offset") - F.col("delta"))
    there = b.select(*keys, F.col("offset").alias("b_off"), "length", "digest")
    equal = moved.join(there, [*keys, "b_off", "length", "digest"]).join(found.withColumn("anchor", F.lit(1)), [*keys, "delta", "offset"], "left")
    order = Window.partitionBy(*keys, "delta").orderBy("offset")
    apart = F.coalesce(F.col("offset") != F.lag(F.col("offset") + F.col("length")).over(order), F.lit(True))
    islands = equal.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "delta", "_run")
    whole = islands.agg(F.min("offset").alias("a_start"), F.max(F.col("offset") + F.col("length")).alias("a_end"), F.max("anchor").alias("anchor")).where("anchor = 1").drop("_run", "anchor")
    whole = written(whole.withColumns({"b_start": F.col("a_start") - F.col("delta"), "b_end": F.col("a_end") - F.col("delta")}), "runs")

    def beside(end: str, place: Column, content: Column, name: str) -> DataFrame:
        """At one end of runs the bytes that the tiles there share. Only their number goes on."""
        places = [f"a_{end}", f"b_{end}"]
        tile_at = lambda side, at: _only(side.select(*keys, place.alias(at), content.alias(f"{at}_bytes")), whole, keys, at)
        both = whole.select(*keys, *places).join(tile_at(a, places[0]), [*keys, places[0]]).join(tile_at(b, places[1]), [*keys, places[1]])
        return both.select(*keys, *places, _common_prefix(*(f"{at}_bytes" for at in places)).alias(name))

    after = beside("end", F.col("offset"), F.col("bytes"), "_right")
    before = beside("start", F.col("offset") + F.col("length"), F.reverse(F.hex("bytes")).cast("binary"), "_left")
    grown = whole.join(after, [*keys, "a_end", "b_end"], "left").join(before, [*keys, "a_start", "b_start"], "left")
    left, right = F.floor(F.coalesce("_left", F.lit(0)) / 2), F.coalesce("_right", F.lit(0))
    out = grown.select(*keys, (F.col("a_start") - left).alias("a_start"), (F.col("b_start") - left).alias("b_start"), (F.col("a_end") - F.col("a_start") + left + right).alias("bytes"))
    return out.where(F.col("bytes") >= least_bytes)


def _heaviest(found: list[tuple]) -> Iterator[tuple]:
    """Of runs (a_start, b_start, bytes) in order: each with its place in the heaviest forward chain, or none."""
    table = np.array(found, np.int64).reshape(-1, 3)
    a, b, size = table.T
    best, prior = size.copy(), np.full(len(table), -1)
    for i in range(len(table)):
        ahead = np.flatnonzero((a[:i] + size[:i] <= a[i]) & (b[:i] + size[:i] <= b[i]))
        if len(ahead):
            j = ahead[np.argmax(best[ahead])]  # the first of equal ones
            best[i], prior[i] = best[j] + size[i], j
    at, chain = int(np.argmax(best)), []
    while at >= 0:
        chain.append(at)
        at = int(prior[at])
    place = {i: n for n, i in enumerate(reversed(chain))}
    for i, row in enumerate(table.tolist()):
        yield (*row, place.get(i))


def chain(found: DataFrame, keys: Sequence[str], key_types: str) -> DataFrame:
    """Runs with ``place``, from 0, in the pair's heaviest chain that goes forward, without overlap, on both sides; null for runs beside it.

    A task holds the runs of one pair: of at least ``least_bytes`` each, so few.
    """
    return _fold(found, keys, ["a_start", "b_start", "bytes"], ["a_start", "b_start", "bytes"], _heaviest, f"{key_types}, a_start long, b_start long, bytes long, place int")


def times_at(points: DataFrame, tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points (keys, byte) with ``second``: the time of the tile there and the part of it that lies ahead; the end of the stream for its size. Distinct points."""
    block = lambda x: F.floor(x / BLOCK)
    last = F.col("offset") + F.col("length") - F.when(F.col("offset") + F.col("length") == F.col("size"), 0).otherwise(1)
    spread = tiles.select(*keys, "offset", "length", "at", "seconds", last.alias("last"), F.explode(F.sequence(block(F.col("offset")), block(last))).alias("_block"))
    wanted = points.select(*keys, "byte").distinct().withColumn("_block", block(F.col("byte")))
    inside = wanted.join(spread, [*keys, "_block"]).where("byte BETWEEN offset AND last")
    # at a boundary of the stream's end two tiles may hold the byte: the later one
    part = F.max_by(F.col("at") + (F.col("byte") - F.col("offset")) / F.col("length") * F.col("seconds"), "offset")
    return inside.groupBy(*keys, "byte").agg(part.alias("second"))


SLOT_KINDS = ("head", "tail", "replaced", "removed_in_b", "inserted_in_b")


def slots(a: DataFrame, b: DataFrame, keys: Sequence[str], key_types: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """What lies between the common runs of two streams, in bytes and seconds of a: keys, kind, a_start, a_end, a_bytes, b_bytes, start, end, left_flank, right_flank.

    A pair without a common run has no slots. Flanks are the seconds of the runs on both sides, 0 at the streams' ends. Tiles are
    made once, of both sides in one go, as they are read a dozen times: mostly without their bytes.
    """
    tiles = written(a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1))), "tiles", codec="zstd")
    a, b = (tiles.where(F.col("_side") == side).drop("_side") for side in (0, 1))
    chained = chain(runs(a, b, keys, least_bytes), keys, key_types).where("place IS NOT NULL")
    chained = written(chained.withColumns({"a_end": F.col("a_start") + F.col("bytes"), "b_end": F.col("b_start") + F.col("bytes")}), "chain")
    ends = lambda side, name: side.groupBy(*keys).agg(F.max("leading").alias(f"{name}_lead"), F.max("size").alias(f"{name}_size"))
    order = Window.partitionBy(*keys).orderBy("place")
    after = {f"{c}_next": F.lead(c).over(order) for c in ("a_start", "b_start", "a_end")}
    sized = chained.withColumns(after).join(ends(a, "a"), list(keys)).join(ends(b, "b"), list(keys))
    gap = lambda kind, a0, a1, b0, b1, l0, l1, r0, r1: F.struct(F.lit(kind).alias("kind"), *(x.cast("long").alias(n) for n, x in (("a_start", a0), ("a_end", a1), ("b_start", b0), ("b_end", b1), ("l0", l0), ("l1", l1), ("r0", r0), ("r1", r1))))
    c, none = F.col, F.lit(None)
    behind = F.when(c("a_start_next").isNull(), gap("tail", c("a_end"), c("a_size"), c("b_end"), c("b_size"), c("a_start"), c("a_end"), none, none)).otherwise(gap("between", c("a_end"), c("a_start_next"), c("b_end"), c("b_start_next"), c("a_start"), c("a_end"), c("a_start_next"), c("a_end_next")))
    ahead = F.when(c("place") == 0, gap("head", c("a_lead"), c("a_start"), c("b_lead"), c("b_start"), none, none, c("a_start"), c("a_end")))
    gaps = sized.select(*keys, F.explode(F.array_compact(F.array(ahead, behind))).alias("g")).select(*keys, "g.*")
    gaps = gaps.withColumns({"a_bytes": c("a_end") - c("a_start"), "b_bytes": c("b_end") - c("b_start")}).where("a_bytes > 0 OR b_bytes > 0")
    kind = F.when(c("kind") != "between", c("kind")).when((c("a_bytes") > 0) & (c("b_bytes") > 0), "replaced").when(c("a_bytes") > 0, "removed_in_b").otherwise("inserted_in_b")
    gaps = written(gaps.withColumn("kind", kind), "slots")
    places = ("a_start", "a_end", "l0", "l1", "r0", "r1")
    points = reduce(DataFrame.unionByName, (gaps.select(*keys, c(p).alias("byte")) for p in places)).where("byte IS NOT NULL")
    at = written(times_at(points, a, keys), "times")
    timed = gaps
    for p in places:
        timed = timed.join(at.select(*keys, c("byte").alias(p), c("second").alias(f"{p}_s")), [*keys, p], "left")
    flank = lambda side: F.coalesce(c(f"{side}1_s") - c(f"{side}0_s"), F.lit(0.0))
    return timed.select(*keys, "kind", "a_start", "a_end", "a_bytes", "b_bytes", c("a_start_s").alias("start"), c("a_end_s").alias("end"), flank("l").alias("left_flank"), flank("r").alias("right_flank"))
