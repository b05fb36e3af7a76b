"""Queries of brackets around spans. Windows are a user's events in order, two seconds each; purchases are the spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import brackets as br
from spanloom.plans.common import SPAN_SQL, rounded, second_spans


def _windows(spark, sf_dir):
    rows = second_spans(spark, sf_dir)
    part = lambda x: (x % 10) / 10
    return rows.select("user_id", "event_id", "kind", "k", (F.col("ord") * 2.0).alias("start"), (F.col("ord") * 2.0 + 2).alias("end"), rounded("u", 2).alias("level"), part(F.col("k")).alias("onset"), part(F.floor(F.col("k") / 10)).alias("offset"), part(F.col("event_id") * 7 + F.col("k")).alias("music"))


def bracketed(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    spans = windows.where("kind = 'purchase'").select("user_id", F.col("event_id").alias("id"), "start", (F.col("start") + 12).alias("end"), (F.col("k") / 100).alias("trust"))
    found = br.brackets(windows, spans, ["user_id"], "user_id long", bucket=64, stretch=16.0)
    return found.select("user_id", "id", "onset", "offset", "template", F.round(F.col("score") + 1e-9, 6).alias("score"))


_BRACKET = f"""{SPAN_SQL}, w AS (SELECT user_id, event_id, kind, k, ord * 2e0 AS s, ord * 2e0 + 2 AS e, round(u, 2) AS level, (k % 10) / 10 AS onset, (k // 10 % 10) / 10 AS off, ((event_id * 7 + k) % 10) / 10 AS music FROM sp),
ln AS (SELECT user_id, coalesce(min(s) FILTER (WHERE ord = 2) - min(s) FILTER (WHERE ord = 1), 2e0) AS len FROM (SELECT user_id, ord, ord * 2e0 AS s FROM sp) GROUP BY 1),
c AS (SELECT w.user_id, event_id AS id, s AS cs, s + 12 AS ce, k / 100 AS trust, len FROM w JOIN ln USING (user_id) WHERE kind = 'purchase'),
near AS (SELECT c.*, w.s, w.e, level, onset, off, music, row_number() OVER (PARTITION BY c.id ORDER BY w.s) AS i, avg(level) OVER (PARTITION BY c.id) AS mean, count(*) OVER (PARTITION BY c.id) AS n FROM c JOIN w ON w.user_id = c.user_id AND w.e >= cs - len * 5 AND w.s <= ce + len * 5),
m AS (SELECT id, 0::BIGINT AS i, 'idle' AS st, 0::BIGINT AS gap, 0::BIGINT AS bed, 0::BIGINT AS drops, NULL::DOUBLE AS o, 0e0 AS ol, 0e0 AS os, NULL::DOUBLE AS f, 0e0 AS fs, []::DOUBLE[] AS trail FROM c
UNION ALL SELECT id, i,
CASE WHEN st = 'idle' THEN CASE WHEN b THEN 'onset' ELSE st END WHEN st = 'onset' THEN CASE WHEN l THEN 'bed' WHEN gap + 1 > 2 THEN 'idle' ELSE st END WHEN st = 'bed' THEN CASE WHEN NOT l AND drops + 1 >= 6 THEN 'idle' WHEN x AND bed + l::INT >= 2 THEN 'offset' ELSE st END WHEN st = 'offset' THEN CASE WHEN len(trail) + 1 >= 3 THEN 'done' ELSE st END ELSE st END,
CASE WHEN st = 'onset' THEN gap + 1 ELSE 0 END,
CASE WHEN st = 'onset' AND l THEN 1 WHEN st = 'bed' THEN CASE WHEN l THEN bed + 1 WHEN drops + 1 >= 6 THEN 0 ELSE bed END ELSE bed END,
CASE WHEN st = 'bed' AND NOT l AND drops + 1 < 6 THEN drops + 1 ELSE 0 END,
CASE WHEN st = 'idle' AND b THEN s WHEN (st = 'onset' AND NOT l AND gap + 1 > 2) OR (st = 'bed' AND NOT l AND drops + 1 >= 6) THEN NULL ELSE o END,
CASE WHEN st = 'idle' AND b THEN level ELSE ol END, CASE WHEN st = 'idle' AND b THEN onset ELSE os END,
CASE WHEN st = 'bed' AND NOT (NOT l AND drops + 1 >= 6) AND x AND bed + l::INT >= 2 THEN e ELSE f END, CASE WHEN st = 'bed' AND NOT (NOT l AND drops + 1 >= 6) AND x AND bed + l::INT >= 2 THEN off ELSE fs END,
CASE WHEN st = 'offset' THEN list_append(trail, level) ELSE trail END
FROM (SELECT m.*  EXCLUDE (i), near.i, near.s, near.e, near.level, near.onset, near.off, near.onset >= 0.3e0 AND near.s <= cs + len AS b, near.music >= 0.25e0 AS l, near.off >= 0.3e0 AND near.s >= ce - len AS x FROM m JOIN near ON near.id = m.id AND near.i = m.i + 1)),
z AS (SELECT m.*, near.user_id, cs, ce, trust, mean, CASE WHEN o IS NULL THEN 0 ELSE os END AS a, coalesce(mean > 0 AND o IS NOT NULL AND round(ol / mean, 9) >= 1.5e0, false) AS sharp, CASE WHEN len(trail) >= 2 THEN len(list_filter(range(2, len(trail) + 1), lambda j: trail[j - 1] > 0 AND (trail[j - 1] - trail[j]) / trail[j - 1] >= 0.15e0)) > (len(trail) - 1) // 2 ELSE false END AS fades FROM m JOIN near ON near.id = m.id AND near.i = m.i AND near.n = m.i WHERE near.n >= 3 AND (o IS NOT NULL OR f IS NOT NULL))
SELECT user_id, id, coalesce(o, cs) AS onset, coalesce(f, ce) AS "offset", CASE WHEN o IS NULL THEN 'partialOffset' WHEN f IS NULL THEN 'partialOnset' WHEN sharp AND fades THEN 'hardInFadeOut' WHEN sharp THEN 'stingInBedDryOut' WHEN NOT fades AND a > 0 AND fs > 0 AND least(a, fs) / greatest(a, fs) >= 0.5e0 THEN 'symmetricBracket' WHEN fs > a THEN 'dryInStingOut' ELSE 'stingInBedDryOut' END AS template,
round(least(greatest((CASE WHEN o IS NOT NULL AND f IS NOT NULL THEN 0.4e0 ELSE 0.15e0 END + least(a, 1e0) * 0.15e0 + least(fs, 1e0) * 0.15e0 + least(bed / 5, 1e0) * 0.15e0) * (0.5e0 + 0.5e0 * trust), 0e0), 1e0) + 1e-9, 6) AS score FROM z"""

QUERIES = {
    "win_bracket": (bracketed, f"WITH RECURSIVE {_BRACKET}"),
}
