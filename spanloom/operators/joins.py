"""Joins on time, order, words and bits, each as an equi-join or one ordered pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import overlap_join, overlap_length
from spanloom.storage import written

#: The end of a run that has not ended.
OPEN_END = 1 << 62
#: Values of a bucket that one cell holds against the bucket, and the tasks that cells are dealt to.
BLOCK_ROWS, PAIR_TASKS = 4096, 240


def words_of(text: Column) -> Column:
    """The distinct words of a text: runs of a-z, 0-9 and letters beyond ASCII, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), lambda w: w != ""))


def term_search(docs: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Keys of the documents that hold all the terms as words."""
    found = words_of(F.col("text"))
    hits = docs.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(found, t)))
    return hits.select(key)


def first_entries(docs: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """Each document's first entry of a lexicon (entry, term) that is a word of it, and how many are.

    Words are joined to terms, so the lexicon may have any size; a document sends each distinct word once.
    """
    each = docs.select(key, F.explode(words_of(F.col("text"))).alias("term"))
    return each.join(lexicon, "term").groupBy(key).agg(F.min(F.struct("entry", "term")).alias("_m"), F.count("*").alias("n_entries")).select(key, F.col("_m.entry").alias("entry"), F.col("_m.term").alias("term"), "n_entries")


def best_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket: int, order: Sequence[Column], keep: dict[str, Column]) -> DataFrame:
    """Each span of A with the least, by ``order``, of the spans of B that overlap it: a running minimum, the group is never sorted.

    In ``order`` and ``keep`` the spans are structs a and b, and ``shared`` is the length of their overlap.
    """
    pairs = overlap_join(a, b, keys, bucket).withColumn("shared", overlap_length())
    ranked = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), *(c.alias(n) for n, c in keep.items()))
    best = pairs.groupBy(*keys, F.col("a.event_id").alias("event_id")).agg(F.min(ranked).alias("_b"))
    return best.select(*keys, "event_id", *(F.col(f"_b.{n}").alias(n) for n in keep))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each left row (keys, at, ...) with the last right ``at`` up to it and the first from it on: before, after."""
    both = left.withColumn("_r", F.lit(None).cast("long")).unionByName(right.select(*keys, "at", F.col("at").alias("_r")), allowMissingColumns=True).withColumn("_side", F.col("_r").isNull().cast("int"))
    up = Window.partitionBy(*keys).orderBy("at", F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    down = Window.partitionBy(*keys).orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"after": F.first("_r", ignorenulls=True).over(up), "before": F.last("_r", ignorenulls=True).over(down)})
    return found.where("_side = 1").drop("_r", "_side")


def cooccurrences(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, within: int) -> DataFrame:
    """How often two values stand at most ``within`` places apart under a key: low, high, n. Each row meets the next few only."""
    window = Window.partitionBy(*keys).orderBy(*order)
    pairs = rows.select(F.col(value).alias("a"), F.array(*(F.lead(value, i).over(window) for i in range(1, within + 1))).alias("next")).select("a", F.explode("next").alias("b")).where("b IS NOT NULL")
    return pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("n"))


def hamming_bands(rows: DataFrame, bits: str, bands: int) -> DataFrame:
    """A row for each band of the 64 bits: band, part. Two values that differ in fewer bits than there are bands share one."""
    width = 64 // bands
    parts = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col(bits), i * width).bitwiseAND((1 << width) - 1).alias("part")) for i in range(bands)]
    return rows.select("*", F.inline(F.array(*parts)))


def hamming_pairs(rows: DataFrame, key: str, bits: str, bands: int, most: int) -> DataFrame:
    """Pairs (a, b, distance) of keys that share a band and differ in at most ``most`` bits. Equal values meet as one.

    A pair counts in the first band that it shares, so what is found is not shuffled again. The few bytes of a bucket make
    many pairs: its values are dealt to blocks of at most about ``BLOCK_ROWS``, each held against the whole bucket, and blocks to a number of tasks that does not go by bytes.
    """
    distinct = written(rows.groupBy(bits).agg(F.min(key).alias("a")), "bits")
    banded = hamming_bands(distinct, bits, bands)
    # a row a bucket: bands * 2 ** (64 / bands) at most, which is more than is broadcast for wide bands
    sizes = banded.groupBy("band", "part").agg(F.count("*").alias("m"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("m > 1").drop("m")
    sized = banded.join(F.broadcast(sizes) if 64 // bands <= 8 else sizes, ["band", "part"])
    cell = ["band", "part", "block"]
    own = sized.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).select(*cell, "a", bits).repartition(PAIR_TASKS, *cell)
    other = sized.select("band", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("b"), F.col(bits).alias("_o"))
    unlike = F.col(bits).bitwiseXOR(F.col("_o"))
    width = 64 // bands
    # the first shared band: none of those before is without a differing bit
    earlier = [F.shiftrightunsigned(unlike, i * width).bitwiseAND((1 << width) - 1) != 0 for i in range(bands)]
    first = reduce(lambda x, y: x & y, ((F.col("band") <= i) | apart for i, apart in enumerate(earlier)))
    near = (F.col("a") < F.col("b")) & (F.bit_count(unlike) <= most)
    return own.join(other, cell).where(near).where(first).select("a", "b", F.bit_count(unlike).cast("long").alias("distance"))


def nearest_hamming(queries: DataFrame, store: DataFrame, revoked: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Each query's nearest stored value within ``most`` bits (ties to the newest, then the smaller value), unless a revoked one is as near.

    ``most`` below the number of bands makes the shared band exact.
    """
    bands = max(b for b in (1, 2, 4, 8, 16, 32) if b <= max(1, 2 * most) and b > most)
    near = lambda other: hamming_bands(queries.select(key, bits), bits, bands).join(hamming_bands(other, "_s", bands), ["band", "part"]).withColumn("distance", F.bit_count(F.col(bits).bitwiseXOR(F.col("_s"))).cast("long")).where(F.col("distance") <= most)
    stored = store.select(F.col(bits).alias("_s"), F.col(key).alias("found"), "seen")
    barred = near(revoked.select(F.col(bits).alias("_s"))).select(key).distinct()
    best = near(stored).groupBy(key).agg(F.min(F.struct("distance", (-F.col("seen")).alias("_a"), F.col("_s"), "found")).alias("_m"))
    return best.join(barred, key, "left_anti").select(key, F.col("_m.found").alias("found"), F.col("_m.distance").alias("distance"))
