"""Queries of the window scores, over a user's events in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import features as ft
from spanloom.operators import intervals as iv
from spanloom.plans.common import EVENT_SQL, SPAN_SQL, events, second_spans

_USER, _ORDER = ["user_id"], ["at", "event_id"]
_HOUR = 3600
_W = "(PARTITION BY user_id ORDER BY tm, event_id)"


def _windows(spark, sf_dir):
    """Events as feature windows; one in ten has no speaker."""
    k = F.col("k")
    values = {"rms": F.when(k % 4 == 0, 0.01).otherwise(F.col("u")), "flux": F.col("v") / 50, "music": k / 100, "proxy": F.pmod(k * 7, F.lit(100)) / 100, "speaker": F.when(k % 10 > 0, k % 3)}
    return events(spark, sf_dir).withColumns(values)


def _scored(spark, sf_dir):
    return ft.feature_scores(_windows(spark, sf_dir), _USER, _ORDER)


def feature_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("event_id", *(F.round(f, 6).alias(f) for f in ft.WEIGHTS))


def fused(spark, sf_dir):
    return ft.fuse(_scored(spark, sf_dir)).select("event_id", F.round("fused", 6).alias("fused"), F.array_join("contributors", ",").alias("contributors"))


def funnel(spark, sf_dir):
    return ft.funnel(_scored(spark, sf_dir))


def silence_credit(spark, sf_dir):
    return ft.silence_credit(_windows(spark, sf_dir), _USER, _ORDER, "rms").select("event_id", "credit")


def pause_clusters(spark, sf_dir):
    return ft.pause_clusters(events(spark, sf_dir), _USER, _ORDER, "at", F.col("k") > 60)


def _signals(spark, sf_dir):
    """Seconds of three kinds of signals: large steps, values far above the rest, and pauses."""
    rows = second_spans(spark, sf_dir)
    high = rows.groupBy("user_id").agg(F.percentile("v", F.lit(0.8)).alias("p"))
    window = ft.Window.partitionBy("user_id").orderBy(*_ORDER)
    before = F.lag("u").over(window)
    top = F.greatest("u", before)
    energy = rows.withColumn("_b", before).where("_b IS NOT NULL").where((F.greatest("u", "_b") >= 0.05) & (F.abs(F.col("u") - F.col("_b")) >= 0.25) & (F.abs(F.col("u") - F.col("_b")) / F.greatest("u", "_b") > 0.35))
    spike = rows.join(high, "user_id").where(F.col("v") > 2 * F.col("p"))
    pause = ft.pause_clusters(rows, _USER, _ORDER, "start", F.col("k") > 60)
    named = lambda df, s: df.select("user_id", "start", F.lit(s).alias("signal"))
    return named(energy, "energy").unionByName(named(spike, "spike")).unionByName(named(pause, "pause"))


def breaks(spark, sf_dir):
    return ft.breaks(_signals(spark, sf_dir), _USER, "start", width=12 * _HOUR).select("user_id", F.round("time", 3).alias("time"), F.round("strength", 6).alias("strength"), "n")


def music_runs(spark, sf_dir):
    """Runs of likely music that miss one window at most and last a day."""
    return ft.sustained_runs(second_spans(spark, sf_dir).withColumn("music", F.col("k") / 100), _USER, _ORDER, F.col("k") >= 50, "music", gap_rows=1, least=24 * _HOUR).select("user_id", "start", "end", F.round("confidence", 6).alias("confidence"))


def music_direction(spark, sf_dir):
    rows = ft.music_direction(_windows(spark, sf_dir), _USER, _ORDER, "music", scale=2.5)
    return rows.select("event_id", *(F.round(c, 6).alias(c) for c in ("onset", "offset", "change")))


def edge_steps(spark, sf_dir):
    return ft.edge_steps(events(spark, sf_dir), _USER, _ORDER, "v", width=4).where("z >= 1").select("event_id", F.round("z", 6).alias("z"))


def music_change(spark, sf_dir):
    """Change of the music value from one event to the next, 0 at first."""
    before = F.lag("k").over(ft.Window.partitionBy("user_id").orderBy(*_ORDER))
    return events(spark, sf_dir).select("event_id", F.abs(F.col("k") - F.coalesce(before, F.col("k"))).alias("change"))


def silence_plans(spark, sf_dir):
    """Quiet stretches by kind; at least an hour of one kind."""
    kind = F.when(F.col("k") < 30, "deadAir").when(F.col("k") < 55, "music").when(F.col("k") < 70, "pause")
    return ft.silence_plans(second_spans(spark, sf_dir), _USER, kind, least=_HOUR)


def uncovered(spark, sf_dir):
    """What purchases leave uncovered of each user's time from first to last event."""
    rows = second_spans(spark, sf_dir)
    bounds = rows.groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ft.complement(iv.merge(rows.where("kind = 'purchase'"), _USER), bounds, _USER)


def cover_partition(spark, sf_dir):
    """Events by whether a purchase covers a part of them: what is uncovered comes first."""
    rows = second_spans(spark, sf_dir)
    covered = iv.overlap_join(rows.where("kind <> 'purchase'"), iv.merge(rows.where("kind = 'purchase'"), _USER), _USER, bucket=6 * _HOUR).select(F.col("a.event_id").alias("event_id")).distinct().withColumn("covered", F.lit(True))
    some = rows.where("kind <> 'purchase'").join(covered, "event_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    place = F.row_number().over(ft.Window.partitionBy("user_id").orderBy("covered", "ord"))
    return some.select("event_id", "user_id", "covered", place.alias("place"))


def skip_padding(spark, sf_dir):
    """Margins by anchor tier: strong anchors keep wide ends, weak ones start later and end earlier."""
    lead = F.when(F.col("k") >= 70, 0.5).when(F.col("k") >= 40, 1.0).otherwise(2.0)
    trail = F.when(F.col("k") >= 70, 0.25).when(F.col("k") >= 40, 0.75).otherwise(1.5)
    rows = second_spans(spark, sf_dir).select("event_id", (F.col("start") + lead).alias("from"), (F.col("end") - trail).alias("to"))
    return rows.where(F.col("to") > F.col("from"))


def asymmetric_error(spark, sf_dir):
    """Signed differences of neighbours' values; a late one costs half as much again."""
    gap = F.col("v") - F.lag("v").over(ft.Window.partitionBy("user_id").orderBy(*_ORDER))
    each = events(spark, sf_dir).select("user_id", gap.alias("gap")).where("gap IS NOT NULL")
    penalty = F.when(F.col("gap") > 0, 1.5 * F.col("gap")).otherwise(-F.col("gap"))
    return each.groupBy("user_id").agg(F.round(F.avg(penalty), 6).alias("penalized"), F.round(F.avg("gap"), 6).alias("bias"))


_WIN_SQL = EVENT_SQL + ", w AS (SELECT *, CASE WHEN k % 4 = 0 THEN 0.01e0 ELSE u END AS rms, v / 50 AS flux, k / 100 AS music, (k * 7 % 100) / 100 AS proxy, CASE WHEN k % 10 > 0 THEN k % 3 END AS speaker FROM ev)"
_CREDIT = f"n AS (SELECT *, rms <= 0.02e0 AS q, row_number() OVER {_W} AS rn, row_number() OVER {_W} - row_number() OVER (PARTITION BY user_id, rms <= 0.02e0 ORDER BY tm, event_id) AS run FROM w), l AS (SELECT *, CASE WHEN q AND count(*) OVER (PARTITION BY user_id, q, run) <= 4 THEN 1 ELSE 0 END AS own FROM n), c AS (SELECT *, max(own) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS credit FROM l)"
_RAMP = lambda x, a, b: f"greatest(0, least(1, (({x}) - {a}e0) / ({b}e0 - {a}e0)))"
_DB = "20 * log10(greatest(rms, 1e-6))"
_MODE = "(SELECT x FROM (SELECT unnest(hist) AS x) WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)"
_SCORES = f"""{_WIN_SQL}, {_CREDIT}, b AS (SELECT user_id, list_extract(list_sort(list({_DB})), CAST(count(*) // 2 + 1 AS INTEGER)) AS quiet, median(flux) AS mflux FROM w GROUP BY 1),
h AS (SELECT c.*, quiet, mflux, max(rms) OVER (PARTITION BY c.user_id ORDER BY rn ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS peak, list(speaker) OVER (PARTITION BY c.user_id ORDER BY rn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS hist, avg(CASE WHEN rms * flux * music >= 0.08e0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY c.user_id ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS density FROM c JOIN b ON b.user_id = c.user_id),
f AS (SELECT event_id, {_RAMP('music', '0.15', '0.85')} AS "musicBed", {_RAMP(f'abs({_DB} - quiet)', '1.5', '6.0')} AS "lufsShift", {_RAMP('CASE WHEN rms <= 0 THEN 1 ELSE least(1, rms / greatest(peak, 1e-6)) END', '0.70', '0.40')} AS "dynamicRange",
greatest({_RAMP('proxy', '0.30', '0.80')}, CASE WHEN speaker IS NOT NULL AND {_MODE} IS NOT NULL AND {_MODE} <> speaker THEN 0.7e0 ELSE 0 END) AS "speakerShift", {_RAMP('CASE WHEN mflux > 0 THEN flux / mflux ELSE 0 END', '1.75', '3.5')} AS "spectralShift", CAST(credit AS DOUBLE) AS "silenceBoundary", greatest(0, least(1, density / 0.6e0)) AS "tempoOnset" FROM h)"""
_FUSED = " + ".join(f'CASE WHEN "{f}" >= 0.01e0 THEN {w}e0 * "{f}" ELSE 0 END' for f, w in ft.WEIGHTS.items())
_NAMES = ", ".join(f"CASE WHEN \"{f}\" >= 0.01e0 THEN '{f}' END" for f in sorted(ft.WEIGHTS))
_PAUSES = f"SELECT user_id, min({{at}}) AS {{name}}, count(*) AS n FROM (SELECT *, row_number() OVER {_W} - row_number() OVER (PARTITION BY user_id, k > 60 ORDER BY tm, event_id) AS run FROM {{source}}) WHERE k > 60 GROUP BY user_id, run HAVING count(*) >= 2"
_SIGNALS = f"""steps AS (SELECT *, lag(u) OVER {_W} AS b FROM sp), high AS (SELECT user_id, quantile_cont(v, 0.8) AS p FROM sp GROUP BY 1), signals AS (
SELECT user_id, s AS t, 'energy' AS signal FROM steps WHERE b IS NOT NULL AND greatest(u, b) >= 0.05e0 AND abs(u - b) >= 0.25e0 AND abs(u - b) / greatest(u, b) > 0.35e0
UNION ALL SELECT sp.user_id, s, 'spike' FROM sp JOIN high ON high.user_id = sp.user_id WHERE v > 2 * p
UNION ALL SELECT user_id, t, 'pause' FROM ({_PAUSES.format(at='s', name='t', source='sp')})),
pts AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM (SELECT DISTINCT user_id, t FROM signals)),
walk AS (SELECT user_id, t, rn, t AS g FROM pts WHERE rn = 1 UNION ALL SELECT p.user_id, p.t, p.rn, CASE WHEN p.t - walk.g <= 43200 THEN walk.g ELSE p.t END FROM walk JOIN pts p ON p.user_id = walk.user_id AND p.rn = walk.rn + 1)"""

QUERIES = {
    "win_feature_scores": (feature_scores, f"WITH {_SCORES} SELECT event_id, " + ", ".join(f'round("{f}", 6) AS "{f}"' for f in ft.WEIGHTS) + " FROM f"),
    "win_fuse": (fused, f"WITH {_SCORES} SELECT event_id, round(greatest(0, least(1, {_FUSED})), 6) AS fused, array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS contributors FROM f"),
    "win_funnel": (funnel, f"WITH {_SCORES} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER (WHERE \"{f}\" > 0) AS produced, count(*) FILTER (WHERE \"{f}\" >= {g}e0) AS gated FROM f" for f, g in ft.GATES.items())),
    "win_silence_credit": (silence_credit, f"WITH {_WIN_SQL}, {_CREDIT} SELECT event_id, credit FROM c"),
    "win_pause_cluster": (pause_clusters, f"WITH {EVENT_SQL} " + _PAUSES.format(at="tm", name="at", source="ev")),
    "win_breaks": (breaks, f"WITH RECURSIVE {SPAN_SQL}, {_SIGNALS} SELECT user_id, round(avg(t), 3) AS time, round(0.4e0 * max(CASE WHEN signal = 'energy' THEN 1 ELSE 0 END) + 0.3e0 * max(CASE WHEN signal = 'spike' THEN 1 ELSE 0 END) + 0.3e0 * max(CASE WHEN signal = 'pause' THEN 1 ELSE 0 END), 6) AS strength, count(*) AS n FROM signals JOIN walk USING (user_id, t) GROUP BY user_id, g"),
    "win_music_offset": (music_runs, f"WITH {SPAN_SQL}, m AS (SELECT *, CASE WHEN ord - lag(ord) OVER (PARTITION BY user_id ORDER BY ord) > 2 THEN 1 ELSE 0 END AS new FROM sp WHERE k >= 50), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ord) AS run FROM m) SELECT user_id, min(s) AS \"start\", arg_max(e, ord) AS \"end\", round(avg(k / 100), 6) AS confidence FROM r GROUP BY user_id, run HAVING arg_max(e, ord) - min(s) >= 86400"),
    "win_musicbed_dir": (music_direction, f"WITH {EVENT_SQL}, d AS (SELECT event_id, coalesce(k / 100 - lag(k / 100) OVER {_W}, 0) AS d FROM ev) SELECT event_id, round(greatest(0, least(1, d * 2.5e0)), 6) AS onset, round(greatest(0, least(1, -d * 2.5e0)), 6) AS \"offset\", round(least(1, abs(d) * 2.5e0), 6) AS change FROM d"),
    "win_forensics": (edge_steps, f"WITH {EVENT_SQL}, d AS (SELECT event_id, user_id, avg(v) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - avg(v) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS d FROM ev), s AS (SELECT user_id, stddev_pop(v) AS s FROM ev GROUP BY 1) SELECT event_id, round(abs(d) / s, 6) AS z FROM d JOIN s USING (user_id) WHERE s > 0 AND abs(d) / s >= 1"),
    "abs_music_change": (music_change, f"WITH {EVENT_SQL} SELECT event_id, abs(k - coalesce(lag(k) OVER {_W}, k)) AS change FROM ev"),
    "win_silence_plan": (silence_plans, f"WITH {SPAN_SQL}, n AS (SELECT *, CASE WHEN k < 30 THEN 'deadAir' WHEN k < 55 THEN 'music' WHEN k < 70 THEN 'pause' END AS kind2, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS rn FROM sp), r AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, kind2 ORDER BY rn) AS run FROM n) SELECT user_id, kind2 AS kind, min(s) AS \"start\", max(e) AS \"end\" FROM r WHERE kind2 IS NOT NULL GROUP BY user_id, kind2, run HAVING max(e) - min(s) >= 3600"),
    "win_revert_partition": (uncovered, f"WITH {SPAN_SQL}, m AS (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sp WHERE kind = 'purchase'), i AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY user_id, g), b AS (SELECT user_id, min(s) AS lo, max(e) AS hi FROM sp GROUP BY 1), g AS (SELECT user_id, lo AS a, coalesce((SELECT min(s) FROM i WHERE i.user_id = b.user_id), hi) AS z FROM b UNION ALL SELECT i.user_id, e, coalesce(lead(s) OVER (PARTITION BY i.user_id ORDER BY s), hi) FROM i JOIN b ON b.user_id = i.user_id) SELECT user_id, a AS \"start\", z AS \"end\" FROM g WHERE z > a"),
    "win_cover_partition": (cover_partition, f"WITH {SPAN_SQL}, c AS (SELECT *, EXISTS (SELECT 1 FROM sp b WHERE b.user_id = a.user_id AND b.kind = 'purchase' AND a.s < b.e AND b.s < a.e) AS covered FROM sp a WHERE kind <> 'purchase') SELECT event_id, user_id, covered, row_number() OVER (PARTITION BY user_id ORDER BY covered, ord) AS place FROM c"),
    "win_skip_padding": (skip_padding, f"WITH {SPAN_SQL}, p AS (SELECT event_id, s + CASE WHEN k >= 70 THEN 0.5e0 WHEN k >= 40 THEN 1e0 ELSE 2e0 END AS a, e - CASE WHEN k >= 70 THEN 0.25e0 WHEN k >= 40 THEN 0.75e0 ELSE 1.5e0 END AS z FROM sp) SELECT event_id, a AS \"from\", z AS \"to\" FROM p WHERE z > a"),
    "win_asym_error": (asymmetric_error, f"WITH {EVENT_SQL}, g AS (SELECT user_id, v - lag(v) OVER {_W} AS gap FROM ev) SELECT user_id, round(avg(CASE WHEN gap > 0 THEN 1.5e0 * gap ELSE -gap END), 6) AS penalized, round(avg(gap), 6) AS bias FROM g WHERE gap IS NOT NULL GROUP BY 1"),
}
