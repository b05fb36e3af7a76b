"""Queries of profiles: users are the shows, device classes and batches; their events, in order, are what is observed."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import profiles as pr
from spanloom.plans.common import EVENT_SQL, events, pick, pick_sql, rounded
from spanloom.streaming import uploads as up

_ORDER, _TYPES = ["at", "event_id"], "at long, event_id long"
_EVENT = {"purchase": "good", "error": "false", "signup": "decay", "click": "override"}


def trust_modes(spark, sf_dir):
    """Purchases are good observations, errors false signals, signups decay; clicks of k below 10 override the mode."""
    event = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in _EVENT.items() if k != "click"), F.when((F.col("kind") == "click") & (F.col("k") < 10), "override"))
    rows = events(spark, sf_dir).withColumns({"event": event, "confidence": rounded("u", 2), "mode": pick(F.col("k"), pr.MODES)})
    return pr.histories(rows, ["user_id"], "user_id long", _ORDER, _TYPES, pr.TrustMode)


def device_profiles(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"seconds": F.round("v", 2), "seed": (20 + F.col("user_id") % 7 * 15).cast("double"), "second": F.col("at") / 1_000_000})
    found = pr.histories(rows.select("user_id", "event_id", "seconds", F.col("second").alias("at"), "seed"), ["user_id"], "user_id long", ["at", "event_id"], "at double, event_id long", pr.DeviceProfile, active=5, divergent=4)
    return found.select("user_id", "event_id", "n", "outside", "happened", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("mean", "average", "factor")))


def jingle_profiles(spark, sf_dir):
    mixed = lambda c: F.when(c % 11 != 0, c * 2_654_435_761 + 12_345)
    rows = events(spark, sf_dir).where("kind IN ('view', 'purchase')").withColumns({"start_hash": mixed(F.col("k")), "end_hash": mixed(F.col("k") * 3 + 1)})
    return pr.histories(rows, ["user_id"], "user_id long", _ORDER, _TYPES, pr.Jingles, near=6, evict=4, most=3).drop("at")


def capabilities(spark, sf_dir):
    k = F.col("k")
    rows = events(spark, sf_dir).withColumns({"chapters": k % 10 < F.col("user_id") % 11, "host": k % 7 < F.col("user_id") % 8, "sponsor": k % 3 > 0, "dynamic": k > 60})
    bed = F.count_if((F.col("kind") == "purchase") & (F.col("user_id") % 5 == 0)) >= 12
    return pr.capability(rows, ["user_id"], bed, F.max(F.col("user_id") % 9 != 4))


def persistence(spark, sf_dir):
    """Hours of a user are passes, the events in them the children."""
    k = F.col("k")
    rows = events(spark, sf_dir).select("user_id", (F.floor(F.col("at") / 3_600_000_000) * 3600).alias("at"), (k < 55).alias("ready"), pick(k, (*pr.BLOCKERS, "other")).alias("reason"), (k % 3 < 2).alias("fixable"))
    return pr.persistent(pr.blockers(rows, ["user_id"], "at"), ["user_id"], "at")


_RN = "row_number() OVER (PARTITION BY user_id ORDER BY tm, event_id)"
_TRUST = f"""{EVENT_SQL}, o AS (SELECT *, {_RN} AS i, CASE WHEN kind = 'purchase' THEN 'good' WHEN kind = 'error' THEN 'false' WHEN kind = 'signup' THEN 'decay' WHEN kind = 'click' AND k < 10 THEN 'override' END AS event, round(u, 2) AS c, {pick_sql('k', pr.MODES)} AS m FROM ev),
w AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS tm, NULL::BIGINT AS event_id, NULL::VARCHAR AS mode, 0::BIGINT AS trust, 0::BIGINT AS obs, 0::BIGINT AS fs, 0::BIGINT AS fp FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT user_id, i, tm, event_id, CASE WHEN event = 'good' THEN CASE WHEN mode IS NULL THEN CASE WHEN c >= 0.92e0 THEN 'manual' ELSE 'shadow' END WHEN mode = 'shadow' AND obs + 1 >= 3 AND least(100, trust + 10) >= 40 THEN 'manual' ELSE mode END WHEN event = 'override' THEN m WHEN event = 'false' THEN CASE WHEN mode = 'auto' AND fs + 1 >= 2 THEN 'manual' WHEN mode = 'manual' AND fs + 1 >= 4 THEN 'shadow' ELSE mode END ELSE mode END,
CASE WHEN event = 'good' THEN CASE WHEN mode IS NULL THEN CASE WHEN c >= 0.92e0 THEN 50 ELSE 20 END ELSE least(100, trust + 10) END WHEN event = 'override' AND mode IS NULL THEN 50 WHEN event = 'false' AND mode IS NOT NULL THEN greatest(0, trust - 10) ELSE trust END,
CASE WHEN event = 'good' THEN obs + 1 ELSE obs END, CASE WHEN event = 'false' AND mode IS NOT NULL THEN fs + 1 WHEN event = 'decay' THEN fs // 2 ELSE fs END, CASE WHEN event = 'false' AND mode IS NOT NULL THEN fp + 1 ELSE fp END
FROM (SELECT w.user_id, o.i, o.tm, o.event_id, mode, trust, obs, fs, fp, o.event, o.c, o.m FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1))
SELECT user_id, tm AS at, event_id, mode, CAST(trust AS INTEGER) AS trust, CAST(obs AS INTEGER) AS observations, CAST(fs AS INTEGER) AS false_signals, CAST(fp AS INTEGER) AS false_positives FROM w WHERE i > 0"""
_DEVICE = f"""{EVENT_SQL}, o AS (SELECT *, {_RN} AS i, round(v, 2) AS x, 20e0 + user_id % 7 * 15 AS seed, tm / 1e6 AS sec FROM ev),
w AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS n, 0e0 AS mean, 0e0 AS avg, 1e0 AS f, 0::BIGINT AS outside, NULL::DOUBLE AS moved, '' AS happened FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT user_id, i, event_id, CASE WHEN h = 'reverted' THEN 0 ELSE n2 END, CASE WHEN h = 'reverted' THEN 0 ELSE mean2 END, CASE WHEN h = 'reverted' THEN 0 ELSE avg2 END, CASE WHEN h = 'reverted' THEN 1 WHEN h = 'moved' THEN goal ELSE f END, CASE WHEN h = 'reverted' THEN 0 ELSE out2 END, CASE WHEN h = 'reverted' THEN NULL WHEN h = 'moved' THEN sec ELSE moved END, h
FROM (SELECT *, CASE WHEN bad THEN 'ignored' WHEN n2 < 5 THEN 'learning' WHEN out2 >= 4 THEN 'reverted' WHEN sec - moved < 86400 THEN 'waiting' WHEN abs(goal - f) <= 2.220446049250313e-16 THEN 'settled' ELSE 'moved' END AS h FROM (SELECT *, least(2e0, greatest(0.5e0, CASE WHEN abs(want - f) <= 0.1e0 THEN want WHEN want > f THEN f + 0.1e0 ELSE f - 0.1e0 END)) AS goal FROM (SELECT *, least(2e0, greatest(0.5e0, avg2 / seed)) AS want, CASE WHEN bad THEN outside WHEN avg2 / seed > 2 OR avg2 / seed < 0.5e0 THEN outside + 1 ELSE 0 END AS out2
FROM (SELECT w.user_id, o.i, o.event_id, o.seed, o.sec, mean, avg, f, outside, moved, NOT coalesce(o.x > 0, false) AS bad, CASE WHEN coalesce(o.x > 0, false) THEN n + 1 ELSE n END AS n2, CASE WHEN coalesce(o.x > 0, false) THEN mean + (o.x - mean) / (n + 1) ELSE mean END AS mean2, CASE WHEN NOT coalesce(o.x > 0, false) THEN avg WHEN n = 0 THEN o.x ELSE 0.2e0 * o.x + (1 - 0.2e0) * avg END AS avg2 FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)))))
SELECT user_id, event_id, CAST(n AS INTEGER) AS n, CAST(outside AS INTEGER) AS outside, happened, round(mean + 1e-9, 5) AS mean, round(avg + 1e-9, 5) AS average, round(f + 1e-9, 5) AS factor FROM w WHERE i > 0"""
_JINGLE = f"""{EVENT_SQL}, e AS (SELECT *, CASE WHEN k % 11 <> 0 THEN k * 2654435761 + 12345 END AS a, CASE WHEN (k * 3 + 1) % 11 <> 0 THEN (k * 3 + 1) * 2654435761 + 12345 END AS b FROM ev WHERE kind IN ('view', 'purchase')), o AS (SELECT *, {_RN} AS i FROM e),
w AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS h, 0::BIGINT AS c, 0::BIGINT AS m, false AS hit FROM (SELECT DISTINCT user_id FROM o)
UNION ALL SELECT user_id, i, event_id, CASE WHEN NOT hit AND m + 1 >= 4 THEN [] ELSE h2[greatest(1, len(h2) - 2):] END, CASE WHEN hit THEN c + 1 WHEN m + 1 >= 4 THEN 0 ELSE c END, CASE WHEN hit OR m + 1 >= 4 THEN 0 ELSE m + 1 END, hit
FROM (SELECT *, CASE WHEN b IS NOT NULL AND len(list_filter(h1, lambda x: bit_count(xor(x, b)) <= 6)) = 0 THEN list_append(h1, b) ELSE h1 END AS h2, coalesce(len(list_filter(h, lambda x: bit_count(xor(x, a)) <= 6)) > 0, false) OR coalesce(len(list_filter(h, lambda x: bit_count(xor(x, b)) <= 6)) > 0, false) AS hit
FROM (SELECT w.user_id, o.i, o.event_id, w.h, w.c, w.m, o.a, o.b, CASE WHEN o.a IS NOT NULL AND len(list_filter(w.h, lambda x: bit_count(xor(x, o.a)) <= 6)) = 0 THEN list_append(w.h, o.a) ELSE w.h END AS h1 FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)))
SELECT user_id, event_id, CAST(len(h) AS INTEGER) AS known, CAST(c AS INTEGER) AS confirmations, CAST(m AS INTEGER) AS misses, hit AS matched, c >= 3 AS confirmed FROM w WHERE i > 0"""
_SHARES = " ".join(f"WHEN {c} / n >= {s}e0 THEN '{v}'" for c, s, v in pr.KINDS)
_REASONS = " ".join(f"WHEN bool_or(reason = '{b}' AND fixable) THEN '{b}'" for b in pr.BLOCKERS)

QUERIES = {
    "abs_trust_mode": (trust_modes, f"WITH RECURSIVE {_TRUST}"),
    "st_device_profile": (device_profiles, f"WITH RECURSIVE {_DEVICE}"),
    "st_jingle_profile": (jingle_profiles, f"WITH RECURSIVE {_JINGLE}"),
    "st_capability": (capabilities, f"WITH {EVENT_SQL}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE k % 10 < user_id % 11) AS chapters, count(*) FILTER (WHERE k % 7 < user_id % 8) AS host, count(*) FILTER (WHERE k % 3 > 0) AS sponsor, count(*) FILTER (WHERE k > 60) AS dynamic, count(*) FILTER (WHERE kind = 'purchase' AND user_id % 5 = 0) >= 12 AS bed FROM ev GROUP BY 1) SELECT user_id, n, chapters, host, sponsor, dynamic, CASE WHEN n < 5 OR user_id % 9 = 4 THEN 'unknown' WHEN bed THEN 'musicBedReliable' {_SHARES} ELSE 'unknown' END AS kind FROM g"),
    "dt_persistence": (persistence, f'''WITH {EVENT_SQL}, c AS (SELECT user_id, tm // 3600000000 * 3600 AS "at", k < 55 AS ready, {pick_sql('k', (*pr.BLOCKERS, 'other'))} AS reason, k % 3 < 2 AS fixable FROM ev), p AS (SELECT user_id, "at", CASE WHEN bool_and(ready) THEN 'tripReady' {_REASONS} END AS candidate FROM c GROUP BY 1, 2), s AS (SELECT *, coalesce(candidate <> 'tripReady', false) AS b, sum(CASE WHEN coalesce(candidate <> 'tripReady', false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY "at") AS g FROM p), t AS (SELECT *, row_number() OVER w AS n, min("at") OVER w AS f FROM s WINDOW w AS (PARTITION BY user_id, g, b ORDER BY "at")) SELECT user_id, "at", candidate, CASE WHEN NOT b OR (n >= 2 AND "at" - f >= 1800) THEN candidate END AS verdict FROM t'''),
}


def counter_upload(spark, sf_dir):
    """Seconds by kind and user group that the second half of the events adds to what the first half sent; errors and group 6 stay."""
    rows = events(spark, sf_dir).select(F.col("kind").alias("counter"), F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("cohort"), F.col("k").alias("n"), (F.col("event_id") % 2 == 0).alias("sent"))
    sums = lambda df: df.groupBy("counter", "cohort").agg(F.sum("n").alias("n"))
    allowed = {"view": None, "purchase": [f"g{i}" for i in range(6)], "click": ["g1", "g2"]}
    return up.envelope(up.delta(sums(rows), sums(rows.where("sent")), ["counter", "cohort"]), allowed)


QUERIES["st_counter_upload"] = (counter_upload, f"WITH {EVENT_SQL}, t AS (SELECT kind AS counter, 'g' || (user_id % 7) AS cohort, sum(k) FILTER (WHERE event_id % 2 = 1) AS n FROM ev GROUP BY 1, 2) SELECT counter, cohort, CAST(n AS BIGINT) AS n FROM t WHERE n > 0 AND (counter = 'view' OR (counter = 'purchase' AND cohort <> 'g6') OR (counter = 'click' AND cohort IN ('g1', 'g2')))")
