"""Operator 8, secret scans with corpus-wide ownership, in DataFrame functions only.

Matches come from the JVM's regular expressions; their places from the lengths of the stretches that
``split`` leaves between them, summed up in blocks of ``BLOCK`` matches. Beside the base kinds, long
mixed tokens of any use are candidates of kind ``generic``. Each candidate value is then counted over the
corpus by distinct repositories and owners: what many owners hold in many repositories is an example that
people copy; any other value looks live, also one that a copied document carries to a few owners. Many are
``WIDE``, or half of all the corpus has where that is less, but two at least. Generic candidates are only
reported if they are owner-specific; base spans always stay, and are counted as owner-specific or copied.

One scan of the texts; from there on only candidates move, and they are made distinct by (value, owner,
repository) ahead of the count. Rows of the scan are written with an id of their own, so that the join
back is by row, not by doc_id.

Defined results: null or empty text has no spans; a null owner or repository is one owner or repository
of its own; repeated rows get one row each; an empty table gives an empty result; only doc_id, text and
the owner and repository columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import materialize

# The kinds in order, their patterns, and the least length of what must be long.
ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # a run is matched whole, so runs of less than 32 may be left out at once
GENERIC = "[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "generic")
_PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, GENERIC), strict=True))
#: So many owners, and as many repositories, make a value a copied example; half of all are enough in a small corpus.
WIDE = 10
BLOCK = 256

_SPAN = "struct<start:bigint,rank:int,end:bigint,value:string>"


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once: ``inline`` of one struct, unlike a projection, is not merged into later uses."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _guarded(kind: str) -> str:
    """The pattern, tried only where a run begins."""
    return {"hex": "(?<![0-9a-f])", "generic": "(?<![A-Za-z0-9+/_-])"}.get(kind, "") + _PATTERNS[kind]


def _blocks(kind: str) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(f"m_{kind}") - 1) / BLOCK).cast("int"))


def _some(kind: str, column: Column, otherwise: str) -> Column:
    return F.when(F.size(f"m_{kind}") > 0, column).otherwise(F.array().cast(otherwise))


def _sums_before(xs: Column, start: Column) -> Column:
    """start, start + x0, start + x0 + x1, ... of a short array."""
    return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _gaps(kind: str) -> Column:
    """The length of the stretch before each match, and of both together."""
    both = F.zip_with(F.split("text", _guarded(kind)), f"m_{kind}", lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), (F.length(gap) + F.coalesce(F.length(m), F.lit(0))).cast("long").alias("all")))
    return _some(kind, both, "array<struct<gap:bigint,all:bigint>>")


def _block_starts(kind: str) -> Column:
    zero = F.lit(0).cast("long")
    totals = F.transform(_blocks(kind), lambda b: F.aggregate(F.slice(f"g_{kind}", b * BLOCK + 1, F.lit(BLOCK)), zero, lambda acc, g: acc + g["all"]))
    return _some(kind, _sums_before(totals, zero), "array<bigint>")


def _ahead(kind: str) -> Column:
    inside = lambda b: F.slice(_sums_before(F.transform(F.slice(f"g_{kind}", b * BLOCK + 1, F.lit(BLOCK)), lambda g: g["all"]), F.get(f"b_{kind}", b)), 1, F.lit(BLOCK))
    return _some(kind, F.flatten(F.transform(_blocks(kind), inside)), "array<bigint>")


def _spans(kind: str) -> Column:
    value = (lambda m: F.regexp_extract(m, ASSIGN, 2)) if kind == "assign" else (lambda m: m)
    good = {
        "assign": lambda s: F.length(s["value"]) >= 8,
        "access": lambda s: F.length(s["value"]) >= 16,
        "hex": lambda s: F.length(s["value"]) >= 32,
        "generic": lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"),
    }[kind]
    start = lambda i: F.get(f"a_{kind}", i) + F.get(f"g_{kind}", i)["gap"]
    spans = F.transform(f"m_{kind}", lambda m, i: F.struct(start(i).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start(i) + F.length(m)).alias("end"), value(m).alias("value")))
    return F.filter(_some(kind, spans, f"array<{_SPAN}>"), good)


def candidates(docs: DataFrame, owner: str, repository: Sequence[str]) -> DataFrame:
    """row, doc_id, owner, repository, base spans and generic spans that touch no base span."""
    named = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.to_json(F.struct(F.col(owner).alias("o"))).alias("owner"), F.to_json(F.struct(*(F.col(c).alias(f"r{i}") for i, c in enumerate(repository)))).alias("repository"))
    found = _step(named, **{f"m_{k}": F.regexp_extract_all("text", F.lit(_guarded(k)), F.lit(0)) for k in KINDS})
    for column, make in (("g", _gaps), ("b", _block_starts), ("a", _ahead), ("s", _spans)):
        found = _step(found, **{f"{column}_{k}": make(k) for k in KINDS})
        found = found.drop("text") if column == "g" else found
    base = F.array_sort(F.concat("s_assign", "s_access", "s_hex"))
    free = F.filter("s_generic", lambda g: ~F.exists(F.concat("s_assign", "s_access", "s_hex"), lambda b: (b["start"] < g["end"]) & (b["end"] > g["start"])))
    return found.select("doc_id", "owner", "repository", base.alias("base"), free.alias("generic"), F.monotonically_increasing_id().alias("row"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _many(n: str, total: str) -> Column:
    return (F.col(n) >= 2) & ((F.col(n) >= WIDE) | (2 * F.col(n) >= F.col(total)))


def find_secrets(docs: DataFrame, owner: str = "source", repository: Sequence[str] = ("source", "lang")) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base), base_sha256, spans (all), n_owner_specific, n_copied (base), n_owners, n_repositories (of each of spans)."""
    scanned = materialize(candidates(docs, owner, repository), "candidates")
    each = scanned.select("row", "owner", "repository", F.explode(F.concat("base", "generic")).alias("span"))
    key = F.sha2(F.col("span.value"), 256)
    held = each.select(key.alias("key"), "owner", "repository").distinct()
    owners = held.select("key", "owner").distinct().groupBy("key").agg(F.count("*").alias("n_owners"))
    repositories = held.groupBy("key").agg(F.count("*").alias("n_repositories"))
    pairs = scanned.select("owner", "repository").distinct().groupBy("owner").agg(F.count("*").alias("n"))
    totals = pairs.agg(F.count("*").alias("all_owners"), F.sum("n").alias("all_repositories"))
    known = owners.join(repositories, "key").crossJoin(F.broadcast(totals))
    copied = _many("n_owners", "all_owners") & _many("n_repositories", "all_repositories")
    judged = each.withColumn("key", key).join(known, "key").select("row", "span", "n_owners", "n_repositories", (~copied).alias("own"))
    generic = KINDS.index("generic")
    reported = F.struct("span.start", "span.rank", "span.end", "n_owners", "n_repositories")
    by_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("span.rank") < generic) | F.col("own"), reported))).alias("every"),
        F.sum(((F.col("span.rank") < generic) & F.col("own")).cast("long")).alias("n_owner_specific"),
        F.sum(((F.col("span.rank") < generic) & ~F.col("own")).cast("long")).alias("n_copied"),
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    listed = lambda c: F.coalesce(F.array_join(F.transform("every", lambda s: s[c].cast("string")), ","), F.lit("")).alias(c)
    return scanned.join(by_row, "row", "left").select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        F.coalesce(_written(F.col("every")), F.lit("")).alias("spans"),
        F.coalesce("n_owner_specific", F.lit(0)).alias("n_owner_specific"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        listed("n_owners"),
        listed("n_repositories"),
    )
