"""Queries of snapshots. Users are the assets, their events the windows; every second event is in the store already, some of it moved a little."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.plans.common import EVENT_SQL, events, pick, pick_sql, table
from spanloom.sources import snapshots as sn

_KINDS = (*sn.STATES, "confirmed")


def _assets(spark, sf_dir):
    users = events(spark, sf_dir).groupBy("user_id").agg(F.max("k").alias("k"))
    return users.select(F.col("user_id").alias("asset"), F.when(F.col("user_id") % 13 != 5, F.concat(F.lit("p"), (F.col("user_id") % 9).cast("string"))).alias("podcast"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("sha"), (F.col("user_id") % 4).alias("version"), F.lit(2_000.0).alias("duration"))


def _windows(spark, sf_dir):
    e = events(spark, sf_dir)
    start = (F.col("event_id") * 7 % 1901).cast("double") / 4
    return e.select(F.col("user_id").alias("asset"), F.col("event_id").alias("id"), start.alias("start"), (start + F.col("k") - 1).alias("end"), (F.col("k") / 99).alias("confidence"), pick(F.col("k"), _KINDS).alias("state"))


def exported(spark, sf_dir):
    found = sn.export(_windows(spark, sf_dir), _assets(spark, sf_dir), 1.7e9)
    return found.select("name", "podcast", "version", "coverage_end", F.size("windows").alias("n"))


def imported(spark, sf_dir):
    assets = _assets(spark, sf_dir)
    snapshots = sn.export(_windows(spark, sf_dir).where("end > start"), assets, 1.7e9)
    store = _windows(spark, sf_dir).where("id % 3 = 0 AND end > start").withColumns({"id": F.col("id") + F.when(F.col("id") % 2 == 0, 1_000_000).otherwise(0), "start": F.col("start") + F.when(F.col("id") % 5 == 0, 0.25).otherwise(0.0)})
    return sn.imported(snapshots, assets, store, "asset long, id long").select("asset", "id", "start", "end", "state")


_SNAP = f"""{EVENT_SQL}, a AS (SELECT DISTINCT user_id AS asset, 'p' || (user_id % 9) AS podcast, 'f' || user_id AS sha, user_id % 4 AS version FROM ev WHERE user_id % 13 <> 5 AND user_id % 4 > 0),
w AS (SELECT user_id AS asset, event_id AS id, (event_id * 7 % 1901) / 4 AS s, (event_id * 7 % 1901) / 4 + k - 1 AS e, k / 99 AS c, {pick_sql('k', _KINDS)} AS state FROM ev)"""

QUERIES = {
    "sink_snapshot": (exported, f"WITH {_SNAP}, j AS (SELECT a.*, w.*, bool_and(e > s AND e <= 2000) OVER (PARTITION BY a.asset ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS fit FROM w JOIN a ON a.asset = w.asset) SELECT sha256(length(podcast) || ':' || podcast || length(sha) || ':' || sha || length(version::VARCHAR) || ':' || version) AS name, podcast, version, max(e) AS coverage_end, CAST(count(*) AS INTEGER) AS n FROM j WHERE fit GROUP BY podcast, sha, version"),
    "src_snapshot": (imported, f"""WITH RECURSIVE {_SNAP}, cand AS (SELECT w.*, row_number() OVER (PARTITION BY w.asset ORDER BY s, e, id) AS i FROM w JOIN a ON a.asset = w.asset WHERE e > s AND state <> 'candidate'),
st AS (SELECT asset, list(id + CASE WHEN id % 2 = 0 THEN 1000000 ELSE 0 END) AS ids, list([s + CASE WHEN id % 5 = 0 THEN 0.25e0 ELSE 0 END, e]) AS at0 FROM w WHERE id % 3 = 0 AND e > s GROUP BY 1),
k AS (SELECT DISTINCT cand.asset, 0::BIGINT AS i, coalesce(ids, []) AS ids, coalesce(at0, []) AS at0, false AS hit FROM cand LEFT JOIN st USING (asset)
UNION ALL SELECT asset, i, CASE WHEN hit THEN list_append(ids, id) ELSE ids END, CASE WHEN hit THEN list_append(at0, [s, e]) ELSE at0 END, hit FROM (SELECT c.*, k.ids, k.at0, NOT list_contains(k.ids, c.id) AND len(list_filter(k.at0, lambda x: abs(x[1] - c.s) <= 0.25e0 AND abs(x[2] - c.e) <= 0.25e0)) = 0 AS hit FROM k JOIN cand c ON c.asset = k.asset AND c.i = k.i + 1))
SELECT cand.asset, cand.id, s AS "start", e AS "end", state FROM k JOIN cand USING (asset, i) WHERE hit"""),
}
