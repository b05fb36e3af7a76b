"""Queries of slots. Views are the fragments of slots, purchases the spans, clicks the breaks and errors what is vetoed, all by user."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import slots as sl
from spanloom.plans.common import SPAN_SQL, rounded, second_spans

_USER, _HOUR = ["user_id"], 3600


def _alignments(spark, sf_dir):
    users = second_spans(spark, sf_dir).groupBy("user_id").agg(F.avg("k").alias("k"))
    user = F.col("user_id")
    return sl.gate(users.select("user_id", F.when(user % 5 == 0, None).otherwise(user % 7).alias("stored_version"), F.when(user % 7 == 3, 9).otherwise(user % 7).alias("version"), (user % 11).alias("stored_identity"), F.least(user % 11, F.lit(8)).alias("identity"), (F.round("k") / 100).alias("fraction")), least=0.48)


def gated(spark, sf_dir):
    """The slots of users whose alignment is accepted; of others the reason alone."""
    outcomes = _alignments(spark, sf_dir)
    return outcomes.select("user_id", "outcome").join(_played(spark, sf_dir).join(outcomes.where(F.col("outcome") == sl.ACCEPTED).select("user_id"), "user_id", "left_semi"), "user_id", "left")


def _played(spark, sf_dir):
    views = second_spans(spark, sf_dir, "view").select("user_id", "start", "end", (F.col("k") * 3).cast("double").alias("left"), (F.col("event_id") % 90).cast("double").alias("right"))
    return sl.merged(views, _USER, gap=_HOUR / 2, longest=3 * _HOUR)


def _spans(spark, sf_dir):
    return second_spans(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("id"), "start", "end")


def owned(spark, sf_dir):
    vetoes = second_spans(spark, sf_dir, "error")
    found = sl.owned(_spans(spark, sf_dir), _played(spark, sf_dir), vetoes, _USER, bucket=6 * _HOUR)
    return found.select("user_id", "id", "slot_start", "slot_end", F.round(F.col("coverage") + 1e-9, 6).alias("coverage"), F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "reason")


def resolved(spark, sf_dir):
    part = lambda *kinds: second_spans(spark, sf_dir, *kinds)
    breaks = part("click", "view", "signup").select("user_id", F.col("start").cast("double").alias("at"), rounded("u", 2).alias("score"))
    spans = _spans(spark, sf_dir).withColumns({"start": F.col("start").cast("double"), "end": F.col("end").cast("double")})
    found = sl.resolved(spans, breaks, part("error"), _USER, bucket=6 * _HOUR, radius=9.0 * _HOUR, inward=0.5 * _HOUR, shortest=600.0, longest=12.0 * _HOUR)
    return found.select("user_id", "id", "slot_start", "slot_end", F.round(F.col("coverage") + 1e-9, 6).alias("coverage"), "confidence", "reason")


_GATE = "al AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN user_id % 7 END AS sv, CASE WHEN user_id % 7 = 3 THEN 9 ELSE user_id % 7 END AS v, round(avg(k)) / 100 AS f FROM sp GROUP BY user_id), oc AS (SELECT user_id, CASE WHEN sv IS NULL OR sv <> v THEN 'staleVersion' WHEN user_id % 11 > 8 THEN 'audioIdentityMismatch' WHEN f < 0.48e0 THEN 'lowAlignedFraction' ELSE 'accepted' END AS outcome FROM al)"
_PLAYED = """vw AS (SELECT user_id, s, e, k * 3e0 AS l, event_id % 90 + 0e0 AS r FROM sp WHERE kind = 'view'),
vi AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1800 THEN 0 ELSE 1 END AS n FROM vw)),
pl AS (SELECT user_id, min(s) AS s, max(e) AS e, arg_min(l, [s, e]) AS l, arg_max(r, [s, e]) AS r FROM vi GROUP BY user_id, g HAVING max(e) - min(s) <= 10800)"""
_PURCHASES = "c AS (SELECT user_id, event_id AS id, s, e FROM sp WHERE kind = 'purchase'), er AS (SELECT user_id, s, e FROM sp WHERE kind = 'error')"
_VETO = "EXISTS (SELECT 1 FROM er WHERE er.user_id = x.user_id AND er.s < er.e AND er.s < x.ze AND er.e > x.zs AND NOT (er.s < x.e AND er.e > x.s))"

QUERIES = {
    "seq_slot_gate": (gated, f'WITH {SPAN_SQL}, {_GATE}, {_PLAYED} SELECT oc.user_id, outcome, s AS "start", e AS "end", l AS "left", r AS "right" FROM oc LEFT JOIN pl ON pl.user_id = oc.user_id AND outcome = \'accepted\''),
    "seq_slot_owned": (owned, f"""WITH {SPAN_SQL}, {_PLAYED}, {_PURCHASES}, m AS (SELECT c.user_id, c.id, pl.s AS zs, pl.e AS ze, l, r, least(c.e, pl.e) - greatest(c.s, pl.s) AS shared, count(*) OVER (PARTITION BY c.id) AS n FROM c JOIN pl ON pl.user_id = c.user_id AND pl.s < c.e AND pl.e > c.s AND c.e > c.s AND pl.e > pl.s QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY shared DESC, pl.s, pl.e) = 1),
x AS (SELECT c.*, zs, ze, n, shared / (c.e - c.s) AS coverage, least(1 - exp(-l / 60), 1 - exp(-r / 60)) AS confidence FROM c LEFT JOIN m ON m.id = c.id)
SELECT user_id, id, zs AS slot_start, ze AS slot_end, round(coverage + 1e-9, 6) AS coverage, round(confidence + 1e-9, 6) AS confidence, CASE WHEN e <= s THEN 'degenerateCore' WHEN zs IS NULL THEN 'noCandidatePairs' WHEN coverage < 0.8e0 AND NOT (zs >= s AND ze <= e AND n = 1) THEN 'coreCoverageBelowMinimum' WHEN {_VETO} THEN 'vetoNewlyEnclosed' END AS reason FROM x"""),
    "seq_slot_resolve": (resolved, f"""WITH RECURSIVE {SPAN_SQL}, {_PURCHASES}, br AS (SELECT user_id, s AS t, max(round(u, 2)) AS score FROM sp WHERE kind IN ('click', 'view', 'signup') GROUP BY 1, 2),
pr AS (SELECT c.user_id, c.id, c.s, c.e, a.t AS zs, b.t AS ze, least(a.score, b.score) AS conf, least(b.t, c.e) - greatest(a.t, c.s) AS shared FROM c JOIN br a ON a.user_id = c.user_id AND a.t BETWEEN c.s - 32400 AND c.s + 1800 JOIN br b ON b.user_id = c.user_id AND b.t BETWEEN c.e - 1800 AND c.e + 32400 WHERE c.e > c.s AND a.t < b.t AND least(b.t, c.e) > greatest(a.t, c.s)),
ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ze - zs - shared, conf DESC, zs, ze) AS i FROM pr WHERE ze - zs BETWEEN 600 AND 43200),
w AS (SELECT id, i, zs, ze, conf, shared FROM ok WHERE i = 1 UNION ALL SELECT w.id, ok.i, CASE WHEN ok.conf >= 1.5e0 * w.conf THEN ok.zs ELSE w.zs END, CASE WHEN ok.conf >= 1.5e0 * w.conf THEN ok.ze ELSE w.ze END, CASE WHEN ok.conf >= 1.5e0 * w.conf THEN ok.conf ELSE w.conf END, CASE WHEN ok.conf >= 1.5e0 * w.conf THEN ok.shared ELSE w.shared END FROM w JOIN ok ON ok.id = w.id AND ok.i = w.i + 1),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1), x AS (SELECT c.*, zs, ze, conf, shared / (c.e - c.s) AS coverage, c.id IN (SELECT id FROM pr) AS paired FROM c LEFT JOIN b ON b.id = c.id)
SELECT user_id, id, CAST(zs AS DOUBLE) AS slot_start, CAST(ze AS DOUBLE) AS slot_end, round(coverage + 1e-9, 6) AS coverage, conf AS confidence, CASE WHEN e <= s THEN 'degenerateCore' WHEN zs IS NULL THEN CASE WHEN paired THEN 'durationOutOfRange' ELSE 'noCandidatePairs' END WHEN conf < 0.15e0 THEN 'edgeBelowFloor' WHEN coverage < 0.8e0 THEN 'coreCoverageBelowMinimum' WHEN {_VETO} THEN 'vetoNewlyEnclosed' END AS reason FROM x"""),
}
