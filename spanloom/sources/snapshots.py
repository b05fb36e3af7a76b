"""Analyses that are shared: a versioned snapshot of an asset's windows, and its import into a store that may hold them already."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.segments import _fold

#: The form of a snapshot, and the forms that are read.
SCHEMA_VERSION, READABLE = 2, (1, 2)
STATES = ("confirmed", "suppressed", "candidate")
#: Windows whose two ends are this near are one; coverage may differ by so much.
NEAR, ROUNDING = 0.25, 1e-6


def share_name(podcast: Column, sha: Column, version: Column) -> Column:
    """A snapshot's name: SHA-256 over the key's parts, each behind its length in bytes, so that no two keys run together."""
    return F.sha2(F.concat(*(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (podcast, sha, version.cast("string")))), 256)


def _valid(duration: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.coalesce(duration, F.lit(float("inf"))) + ROUNDING)
    return F.coalesce(F.col("id").isNotNull() & finite(F.col("start")) & finite(F.col("end")) & inside & F.col("confidence").between(0.0, 1.0) & F.col("state").isin(*STATES), F.lit(False))


def export(windows: DataFrame, assets: DataFrame, exported_at: float) -> DataFrame:
    """A snapshot for each asset (asset, podcast, sha, version, duration) that has a key and windows (asset, id, start, end, confidence, state).

    Windows go out in order up to the first that is not fit to be shared (no id, no proper times, outside the duration, no known state or confidence).
    Columns: name, podcast, sha, version, schema_version, exported_at, coverage_end, windows.
    """
    keyed = assets.where("podcast <> '' AND sha <> '' AND version > 0").select("asset", "podcast", "sha", "version", "duration")
    order = Window.partitionBy("asset").orderBy(F.asc_nulls_first("start"), F.asc_nulls_first("end"), F.asc_nulls_first("id"))
    judged = windows.join(keyed, "asset").withColumn("_fit", F.min(_valid(F.col("duration")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = judged.where("_fit = 1").groupBy("asset", "podcast", "sha", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "confidence", "state"))).alias("windows"), F.max("end").alias("coverage_end"))
    return each.select(share_name(F.col("podcast"), F.col("sha"), F.col("version")).alias("name"), "podcast", "sha", "version", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(float(exported_at)).alias("exported_at"), "coverage_end", "windows")


def refusals(snapshots: DataFrame, assets: DataFrame) -> DataFrame:
    """Snapshots that name a local asset's podcast and file, with ``asset`` and ``reason``: null if it may come in, else why not."""
    local = assets.select("asset", "podcast", "sha", F.col("version").alias("own_version"), "duration")
    met = snapshots.join(local, ["podcast", "sha"])
    ends = F.array_max(F.transform("windows", lambda w: w["end"]))
    bad = F.exists("windows", lambda w: ~F.coalesce(w["id"].isNotNull() & (w["start"] >= 0) & (w["end"] > w["start"]) & (w["end"] < float("inf")) & w["confidence"].between(0.0, 1.0) & w["state"].isin(*STATES), F.lit(False)))
    ids = F.transform("windows", lambda w: w["id"])
    reason = (
        F.when(~F.col("schema_version").isin(*READABLE) | F.col("schema_version").isNull(), "schemaVersion")
        .when(~F.col("version").eqNullSafe(F.col("own_version")), "analysisVersion")
        .when(~F.coalesce((F.col("exported_at") >= 0) & (F.col("exported_at") < float("inf")), F.lit(False)), "exportedAt")
        .when(F.coalesce(F.size("windows"), F.lit(0)) <= 0, "windows").when(bad, "window")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "windowId")
        .when(~F.coalesce(F.abs(F.col("coverage_end") - ends) <= ROUNDING, F.lit(False)), "coverageEnd")
        .when(ends > F.col("duration") + ROUNDING, "duration")
    )
    return met.select("name", "asset", "schema_version", "version", "windows", reason.alias("reason"))


def _new_windows(rows: list[tuple]) -> Iterator[tuple]:
    """Of an asset's windows in order of start those that come in: not known by id, and near no window that is there or came in before."""
    known = {r[5] for r in rows if r[0] == 0}
    behind: list[tuple] = []  # windows whose start may still be near
    stored = [r for r in rows if r[0] == 0]
    at = 0
    for side, start, end, confidence, state, ident in rows:
        if side == 0:
            continue
        while at < len(stored) and stored[at][1] <= start + NEAR:
            behind.append(stored[at])
            at += 1
        behind = [b for b in behind if b[1] >= start - NEAR]
        if ident in known or any(abs(b[1] - start) <= NEAR and abs(b[2] - end) <= NEAR for b in behind):
            continue
        known.add(ident)
        behind.append((side, start, end, confidence, state, ident))
        yield ident, start, end, confidence, state


def imported(snapshots: DataFrame, assets: DataFrame, store: DataFrame, types: str = "asset string, id string") -> DataFrame:
    """Windows (asset, id, start, end, confidence, state) that the snapshots add to the store, which has the same columns.

    Refused snapshots add nothing, candidates are not taken over, and neither is a window that the store, or an earlier one of the import, has by id or
    within ``NEAR`` of both ends; so the same import adds nothing the second time. A task holds one asset's windows at a time.
    """
    accepted = refusals(snapshots, assets).where("reason IS NULL").select("asset", F.explode("windows").alias("w")).select("asset", "w.id", "w.start", "w.end", "w.confidence", "w.state").where("state <> 'candidate'")
    rows = store.select("asset", "id", "start", "end", "confidence", "state", F.lit(0).alias("side")).unionByName(accepted.withColumn("side", F.lit(1)))
    wanted = rows.join(accepted.select("asset").distinct(), "asset", "left_semi")
    asset, ident = types.split(", ")
    return _fold(wanted, ["asset"], ["start", "end", "id", "side"], ["side", "start", "end", "confidence", "state", "id"], _new_windows, f"{asset}, {ident}, start double, end double, confidence double, state string")
