"""Queries of matching, metrics and calibration: views and clicks of a user predict, purchases are the truth. And of the span machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import evaluate as ev
from spanloom.operators import intervals as iv
from spanloom.operators import segments as sg
from spanloom.plans.common import EVENT_SQL, SPAN_SQL, events, second_spans, table

_USER = ["user_id"]
_HOUR = 3600


def _pairs(spark, sf_dir):
    pairs = iv.overlap_join(second_spans(spark, sf_dir, "view", "click"), second_spans(spark, sf_dir, "purchase"), _USER, bucket=6 * _HOUR)
    return pairs.select("user_id", F.col("a.event_id").alias("p"), F.col("b.event_id").alias("t"), F.col("a.start").alias("ps"), F.col("a.end").alias("pe"), F.col("b.start").alias("ts"), F.col("b.end").alias("te"), F.round(iv.iou(), 9).alias("iou"))


def match_optimal(spark, sf_dir):
    """The number of matches, their whole cost and overlap: which of equally cheap matchings is taken is open."""
    cost = ev.match_cost(F.abs(F.col("ps") - F.col("ts")), F.abs(F.col("pe") - F.col("te")), F.col("iou"))
    return ev.match_optimal(_pairs(spark, sf_dir).withColumn("cost", cost), _USER).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def match_pairs(spark, sf_dir):
    return ev.match_pairs(_pairs(spark, sf_dir), _USER).select("user_id", "p", "t", F.round("iou", 6).alias("iou"))


def _covered(spark, sf_dir):
    """By user, in seconds: covered by both, by predictions alone, by truth alone."""
    swept = iv.sweep(second_spans(spark, sf_dir, "view", "click"), second_spans(spark, sf_dir, "purchase"), _USER)
    part = lambda c: F.sum(F.when(F.expr(c), F.col("end") - F.col("start")).otherwise(0))
    return swept.groupBy("user_id").agg(part("in_a > 0 AND in_b > 0").alias("both"), part("in_a > 0 AND in_b = 0").alias("over"), part("in_a = 0 AND in_b > 0").alias("missed"))


def fp_seconds(spark, sf_dir):
    """Seconds predicted against the truth, by hour of the user's time from first to last event."""
    length = second_spans(spark, sf_dir).groupBy("user_id").agg((F.max("end") - F.min("start")).alias("duration"))
    return _covered(spark, sf_dir).join(length, "user_id").select("user_id", F.col("over").alias("fp_seconds"), F.round(F.try_divide(F.col("over"), F.col("duration") / 3600), 6).alias("per_hour"))


def gate(spark, sf_dir):
    """Greedy matches by user, their precision, recall and boundary errors, and which thresholds they miss."""
    found = ev.match_pairs(_pairs(spark, sf_dir), _USER).where("iou >= 0.05")
    back = _pairs(spark, sf_dir).select("user_id", "p", "t", (F.abs(F.col("ps") - F.col("ts")) + F.abs(F.col("pe") - F.col("te"))).alias("error"))
    matched = found.join(back, ["user_id", "p", "t"]).groupBy("user_id").agg(F.count("*").alias("m"), F.avg(F.col("error") / 2).alias("mean_error"), F.max("error").alias("max_error"))
    counts = second_spans(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("kind").isin("view", "click")).alias("np"), F.count_if(F.col("kind") == "purchase").alias("nt"))
    both = counts.join(matched, "user_id", "left").fillna({"m": 0, "mean_error": 0.0, "max_error": 0})
    precision, recall = ev.precision_recall(F.col("m"), F.col("np"), F.col("nt"))
    rows = both.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6)})
    reasons = ev.gate_reasons({c: F.col(c) for c in ("precision", "recall", "mean_error", "max_error")}, {"precision": 0.1, "recall": 0.2}, {"mean_error": 1500.0, "max_error": 6000.0})
    return rows.select("user_id", "precision", "recall", F.array_join(reasons, ",").alias("reasons"))


def nine(spark, sf_dir):
    """Over all matches: seeds, overlap, median errors with and without sign, coverage."""
    pairs = ev.match_pairs(_pairs(spark, sf_dir), _USER).select("user_id", "p", "t").join(_pairs(spark, sf_dir), ["user_id", "p", "t"])
    start, end = F.col("ps") - F.col("ts"), F.col("pe") - F.col("te")
    stats = pairs.agg(F.count("*").alias("matched"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.median(F.abs(start)).alias("start_error"), F.median(F.abs(end)).alias("end_error"), F.median(start).alias("start_bias"), F.median(end).alias("end_bias"))
    cover = _covered(spark, sf_dir).agg(F.round(F.sum("both") / F.sum(F.col("both") + F.col("missed")), 6).alias("coverage_recall"), F.round(F.sum("both") / F.sum(F.col("both") + F.col("over")), 6).alias("coverage_precision"))
    return stats.crossJoin(cover)  # one row each


def fn_decomposition(spark, sf_dir):
    """Seconds of the truth that no click found, by the reason: never scored, scored low, or not promoted."""
    truth = second_spans(spark, sf_dir, "purchase")
    scored, good = second_spans(spark, sf_dir, "view", "click", "signup"), second_spans(spark, sf_dir, "view", "click", "signup").where("k >= 40")
    missed = iv.subtract(truth, second_spans(spark, sf_dir, "click").where("k >= 40"), _USER)
    parts = {"pipelineCoverage": iv.subtract(missed, scored, _USER), "classifierRecall": iv.intersect(iv.subtract(missed, good, _USER), scored, _USER), "promotionRecall": iv.intersect(missed, good, _USER)}
    each = [df.agg(F.lit(k).alias("cause"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("seconds")) for k, df in parts.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def ground_truth(spark, sf_dir):
    """Purchases as annotations, clicks of a high k added, errors taken away; users with an error of k 99 are left out."""
    veto = events(spark, sf_dir).where("kind = 'error' AND k = 99").select("user_id").distinct()
    base = second_spans(spark, sf_dir, "purchase").unionByName(second_spans(spark, sf_dir, "click").where("k >= 90"))
    return iv.subtract(base, second_spans(spark, sf_dir, "error"), _USER).join(veto, "user_id", "left_anti")


def delta(spark, sf_dir):
    """What clicks (baseline) and views (treatment) cover of each purchase, and what became of it."""
    truth = second_spans(spark, sf_dir, "purchase").where("end > start")

    def share(kind):
        pieces = iv.overlap_join(truth, iv.merge(second_spans(spark, sf_dir, kind), _USER), _USER, bucket=6 * _HOUR)
        return pieces.groupBy(F.col("a.event_id").alias("event_id")).agg(F.sum(iv.overlap_length()).alias(kind))

    both = truth.join(share("click"), "event_id", "left").join(share("view"), "event_id", "left")
    length = F.col("end") - F.col("start")
    before, after = F.coalesce("click", F.lit(0)) / length, F.coalesce("view", F.lit(0)) / length
    verdict = F.when((before > 0) & (after == 0), "FUSION_DROP").when(after < before, "CAND_NARROW").otherwise("OK")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg(after - before), 6).alias("mean_delta"))


def edge_margin(spark, sf_dir):
    """Signed start errors by user: their 5th and 95th percentile, and a bound on misses where none is below -3 hours."""
    rows = _pairs(spark, sf_dir).select("user_id", (F.col("ps") - F.col("ts")).alias("error"))
    each = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("error", F.lit(0.05)).alias("low"), F.percentile("error", F.lit(0.95)).alias("high"), F.count_if(F.col("error") < -3 * _HOUR).alias("early"))
    return each.select("user_id", "n", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), F.when(F.col("early") == 0, F.round(ev.upper_bound(F.col("n")), 6)).alias("bound"))


def gold_score(spark, sf_dir):
    """How much of each purchase is found at all, as percentiles by user."""
    truth = second_spans(spark, sf_dir, "purchase").where("end > start")
    found = iv.overlap_join(truth, iv.merge(second_spans(spark, sf_dir, "view", "click"), _USER), _USER, bucket=6 * _HOUR).groupBy(F.col("a.event_id").alias("event_id")).agg(F.sum(iv.overlap_length()).alias("x"))
    each = truth.join(found, "event_id", "left").select("user_id", (F.coalesce("x", F.lit(0)) / (F.col("end") - F.col("start"))).alias("share"))
    return each.groupBy("user_id").agg(F.count("*").alias("n"), *(F.round(F.percentile("share", F.lit(p)), 6).alias(n) for p, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))))


def materialized(spark, sf_dir):
    """Examples by day: what was scanned, the evidence's ordinals, the best decision, and what users corrected."""
    rows = second_spans(spark, sf_dir).withColumn("day", F.floor(F.col("start") / 86_400))
    one = lambda k: F.count_if(F.col("kind") == k)
    each = rows.groupBy("user_id", "day").agg(F.count("*").alias("scans"), F.min(F.when(F.col("kind") == "click", F.col("ord"))).alias("first"), F.max(F.when(F.col("kind") == "click", F.col("ord"))).alias("last"), F.max(F.when(F.col("kind") == "purchase", F.struct("k", "event_id")))["event_id"].alias("decision"), one("error").alias("corrections"))
    bucket = F.when((F.col("corrections") > 0) & F.col("decision").isNotNull(), "disagreement").when(F.col("decision").isNotNull(), "positive").when(F.col("first").isNull(), "uncertain").otherwise("negative")
    return each.select("user_id", "day", "scans", "first", "last", "decision", bucket.alias("bucket"))


def replay(spark, sf_dir):
    """What would be predicted if views were switched off for odd users: seconds by user."""
    some = second_spans(spark, sf_dir, "view", "click").where("kind = 'click' OR user_id % 2 = 0")
    return iv.union_length(some, _USER)


def music_eval(spark, sf_dir):
    """Boundaries by kind: an error's second counts as found if a purchase begins or ends within half an hour."""
    spans = second_spans(spark, sf_dir, "purchase")
    edges = spans.select("user_id", F.explode(F.array("start", "end")).alias("start")).withColumn("end", F.col("start") + 1)
    cues = second_spans(spark, sf_dir).where("kind <> 'purchase'").select("user_id", "kind", "event_id", (F.col("start") - 1800).alias("start"), (F.col("start") + 1801).alias("end"))
    found = iv.overlap_join(cues, edges, _USER, bucket=6 * _HOUR).select(F.col("a.event_id").alias("event_id")).distinct().withColumn("hit", F.lit(1))
    return cues.join(found, "event_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("precision"))


def platt(spark, sf_dir):
    """Sigmoid of document length for quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(F.col("n_chars") / (F.col("n_chars") + 1000), 3).alias("score"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return ev.platt_fit(rows, "score", F.col("quality") == 1).select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def fm_clusters(spark, sf_dir):
    """Views of a user that overlap by .4 or more of their union as one region: strength by how many."""
    views = second_spans(spark, sf_dir, "view")
    pairs = iv.overlap_join(views, views, _USER, bucket=6 * _HOUR).where("a.event_id < b.event_id").where(iv.iou() >= 0.4)
    labels = ev.components(pairs.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))).withColumnRenamed("node", "event_id")
    each = views.join(labels, "event_id", "left").groupBy(F.coalesce("component", "event_id").alias("cluster")).agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return each.withColumn("strength", F.when(F.col("n") >= 3, "high").when(F.col("n") == 2, "medium").otherwise("low"))


def union_sources(spark, sf_dir):
    """Proposals of all kinds that touch as one region, with the kinds that made it."""
    kinds = ("view", "click", "purchase", "signup", "error")
    flags = [F.when(F.col("kind") == k, F.lit(1)).otherwise(0).cast("long").alias(f"n_{k}") for k in kinds]
    rows = second_spans(spark, sf_dir).select("user_id", "start", "end", *flags)
    return iv.merge(rows, _USER, sums=[f"n_{k}" for k in kinds])


def _atoms(spark, sf_dir):
    """A user's events as atoms: each lasts an hour at most, and until the next one."""
    rows = second_spans(spark, sf_dir)
    after = F.lead("start").over(ev.lag_window(_USER, ["ord"]))
    return rows.select("user_id", F.col("ord").alias("ordinal"), "start", F.least(F.col("start") + 7200, F.coalesce(after, F.col("start") + 7200)).alias("end"), F.col("kind").isin("view", "click", "purchase").alias("anchored"), (F.col("k") == 99).alias("vetoed"), (F.col("k") % 10 == 0).alias("is_break"))


def runs(spark, sf_dir):
    return sg.runs(_atoms(spark, sf_dir), _USER)


def merge_adjacent(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    return sg.merge_adjacent(sg.runs(atoms, _USER), atoms, _USER, gap=12 * _HOUR)


def split_long(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    merged = sg.merge_adjacent(sg.runs(atoms, _USER), atoms, _USER, gap=12 * _HOUR)
    return sg.split_long(merged, atoms, _USER, longest=36 * _HOUR)


def snapped(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    return sg.snap(sg.runs(atoms, _USER), atoms, _USER, radius=8 * _HOUR, bucket=12 * _HOUR)


def resolved(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    return sg.resolve_overlap(sg.snap(sg.runs(atoms, _USER), atoms, _USER, radius=8 * _HOUR, bucket=12 * _HOUR), atoms, _USER)


def decoded(spark, sf_dir):
    return sg.decode(_atoms(spark, sf_dir), _USER, gap=12 * _HOUR, longest=36 * _HOUR, radius=4 * _HOUR, shortest=_HOUR, bucket=12 * _HOUR)


def segmented(spark, sf_dir):
    """Turns said at fifteen characters a second, with silences between them; other speakers are soft breaks."""
    order = ev.lag_window(["conv_id"], ["turn"])
    length, silence = F.length(F.coalesce("text", F.lit(""))) / 15.0, F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(20)) / 10.0
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", length.alias("l"), silence.alias("q"))
    end = F.sum(F.col("l") + F.col("q")).over(order)
    atoms = turns.select("conv_id", F.col("turn").alias("ordinal"), F.round(end - F.col("l"), 3).alias("start"), F.round(end, 3).alias("end"), F.coalesce(F.col("role") != F.lag("role").over(order), F.lit(False)).alias("soft"))
    return sg.segment(atoms, ["conv_id"], longest=20.0, pause=1.5, shortest=5.0).select("conv_id", F.col("ordinal").alias("turn"), F.col("segment").cast("long").alias("segment"))


def hysteresis(spark, sf_dir):
    rows = second_spans(spark, sf_dir).select("user_id", F.col("start").cast("double").alias("start"), (F.col("end") + 1).cast("double").alias("end"), F.round("u", 4).alias("score"))
    return sg.hysteresis_segments(rows, _USER, "user_id long", near=24.0 * _HOUR, lull=2.0 * _HOUR, gap=8.0 * _HOUR, shortest=2.0 * _HOUR).withColumn("score", F.round("score", 6))


_EVIDENCE = {"view": "body", "click": "sponsor", "purchase": "promo", "signup": "disclosure", "error": "return"}


def hypotheses(spark, sf_dir):
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in _EVIDENCE.items()))
    rows = second_spans(spark, sf_dir).select("user_id", (F.col("start") / _HOUR).alias("start"), (F.col("start") / _HOUR + 0.1).alias("end"), kind.alias("kind"), F.lit(1.0).alias("weight"))
    return sg.hypotheses(rows, _USER, "user_id long", decay=0.99).withColumn("confidence", F.round("confidence", 6))


def finalized(spark, sf_dir):
    """Spans of the day on a clock of seconds; a chapter is the user's first purchase."""
    minutes = lambda c: F.col(c) / 60.0
    spans = second_spans(spark, sf_dir, "view", "click").select("user_id", F.col("event_id").cast("string").alias("id"), minutes("start").alias("start"), minutes("end").alias("end"), F.round("u", 4).alias("confidence"), F.when(F.col("k") % 2 == 0, "paid").otherwise("affiliate").alias("intent"), F.when(F.col("k") % 3 == 0, "show").otherwise("thirdParty").alias("ownership"))
    chapters = second_spans(spark, sf_dir, "purchase").select("user_id", minutes("start").alias("start"), minutes("end").alias("end"))
    durations = spans.groupBy("user_id").agg((F.sum(F.col("end") - F.col("start")) * 0.5).alias("duration"))
    return sg.finalize(spans, chapters, durations, _USER, "user_id long", bucket=360)


def live_skips(spark, sf_dir):
    rows = second_spans(spark, sf_dir).select("user_id", "start", "end", F.round("u", 4).alias("score"))
    return sg.live_skips(rows, _USER, gap=float(4 * _HOUR), shortest=float(_HOUR))


def boundary_resolve(spark, sf_dir):
    """Purchases' starts drawn to clicks and views within three hours."""
    points = second_spans(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("id"), F.col("start").alias("at"))
    cues = second_spans(spark, sf_dir, "view", "click").select("user_id", F.col("start").alias("at"), F.col("kind").alias("cue"), F.col("u").alias("strength"))
    return sg.boundary_scores(points, cues, _USER, 3 * _HOUR, {"view": 0.4, "click": 0.6}).select("user_id", "id", "snapped", F.round("score", 6).alias("score"))


def boundary_expand(spark, sf_dir):
    """A tap (error) as a span: the purchase that holds it, else the nearest events on both sides, else half an hour either way."""
    taps = second_spans(spark, sf_dir, "error").select("user_id", "event_id", "start", (F.col("start") + 1).alias("end"))
    held = iv.overlap_join(taps, second_spans(spark, sf_dir, "purchase"), _USER, bucket=6 * _HOUR).groupBy(F.col("a.event_id").alias("event_id")).agg(F.min(F.struct("b.start", "b.end")).alias("h"))
    both = ev.lag_window(_USER, ["start", "event_id"])
    near = second_spans(spark, sf_dir).select("user_id", "event_id", "kind", "start", F.lag("start").over(both).alias("l"), F.lead("start").over(both).alias("r")).where("kind = 'error'").select("event_id", F.when(F.col("start") - F.col("l") <= 2 * _HOUR, F.col("l")).alias("l"), F.when(F.col("r") - F.col("start") <= 2 * _HOUR, F.col("r")).alias("r"))
    found = taps.join(held, "event_id", "left").join(near, "event_id", "left")
    return found.select("event_id", F.coalesce("h.start", "l", F.col("start") - 1800).alias("from"), F.coalesce("h.end", "r", F.col("start") + 1800).alias("to"))


_PAIR_SQL = f"{SPAN_SQL}, pairs AS (SELECT a.user_id, a.event_id AS p, b.event_id AS t, a.s AS ps, a.e AS pe, b.s AS ts, b.e AS te, round((least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)), 9) AS iou FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.kind IN ('view', 'click') AND b.kind = 'purchase')"


def _sweep(a: str, b: str) -> str:
    """Elementary stretches of two sets of spans; what lies in both, in A alone and in B alone."""
    return f"pts AS (SELECT user_id, pt, sum(da) AS da, sum(db) AS db FROM (SELECT user_id, s AS pt, 1 AS da, 0 AS db FROM {a} UNION ALL SELECT user_id, e, -1, 0 FROM {a} UNION ALL SELECT user_id, s, 0, 1 FROM {b} UNION ALL SELECT user_id, e, 0, -1 FROM {b}) GROUP BY 1, 2), sw AS (SELECT user_id, pt AS s, lead(pt) OVER w AS e, sum(da) OVER (w ROWS UNBOUNDED PRECEDING) AS a, sum(db) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY pt))"


_COVER = f"{SPAN_SQL}, pr AS (SELECT * FROM sp WHERE kind IN ('view', 'click')), tr AS (SELECT * FROM sp WHERE kind = 'purchase'), {_sweep('pr', 'tr')}, cov AS (SELECT user_id, coalesce(sum(e - s) FILTER (WHERE a > 0 AND b > 0), 0) AS both, coalesce(sum(e - s) FILTER (WHERE a > 0 AND b = 0), 0) AS over, coalesce(sum(e - s) FILTER (WHERE a = 0 AND b > 0), 0) AS missed FROM sw WHERE e IS NOT NULL GROUP BY 1)"
_ATOM_SQL = f"{SPAN_SQL}, at0 AS (SELECT user_id, ord, s, least(s + 7200, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY ord), s + 7200)) AS e, kind IN ('view', 'click', 'purchase') AS anchored, k = 99 AS vetoed, k % 10 = 0 AS brk FROM sp), r0 AS (SELECT *, ord - row_number() OVER (PARTITION BY user_id ORDER BY ord) AS g FROM at0 WHERE anchored AND NOT vetoed), runs AS (SELECT user_id, min(ord) AS f, max(ord) AS l, arg_min(s, ord) AS s, arg_max(e, ord) AS e FROM r0 GROUP BY user_id, g)"
_MERGED = "m0 AS (SELECT *, lag(l) OVER w AS pl, lag(e) OVER w AS pe FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY f)), m1 AS (SELECT *, CASE WHEN s - pe >= 0 AND s - pe < 43200 AND NOT EXISTS (SELECT 1 FROM at0 x WHERE x.user_id = m0.user_id AND x.ord > pl AND x.ord < f AND (vetoed OR brk)) THEN 0 ELSE 1 END AS new FROM m0), merged AS (SELECT user_id, min(f) AS f, max(l) AS l, arg_min(s, f) AS s, arg_max(e, f) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS g FROM m1) GROUP BY user_id, g)"
_SPLIT = """gp AS (SELECT user_id, min(ord) AS gf, max(ord) AS gl FROM (SELECT *, ord - row_number() OVER (PARTITION BY user_id ORDER BY ord) AS g FROM at0 WHERE vetoed OR NOT anchored) GROUP BY user_id, g),
cuts AS (SELECT user_id, f, l, s, e FROM merged UNION ALL SELECT x.user_id, y.f, y.l, y.s, y.e FROM (SELECT c.*, (SELECT arg_min([gf, gl], (gf - gl) * 1000000 + gf) FROM gp WHERE gp.user_id = c.user_id AND gf > c.f AND gl < c.l) AS gap FROM cuts c WHERE c.e - c.s > 129600 AND c.f < c.l) x, LATERAL (SELECT min(ord) AS f, max(ord) AS l, min(a.s) AS s, max(a.e) AS e FROM at0 a WHERE a.user_id = x.user_id AND a.ord BETWEEN x.f AND coalesce(x.gap[1], (x.f + x.l) // 2) - 1 HAVING count(*) > 0 UNION ALL SELECT min(ord), max(ord), min(a.s), max(a.e) FROM at0 a WHERE a.user_id = x.user_id AND a.ord BETWEEN coalesce(x.gap[2], (x.f + x.l) // 2) + 1 AND x.l HAVING count(*) > 0) y),
split AS (SELECT * FROM cuts WHERE e - s <= 129600 OR f = l)"""
_SNAP = lambda source, radius: f"sn AS (SELECT x.user_id, coalesce((SELECT arg_min(ord, ord) FROM at0 a WHERE a.user_id = x.user_id AND brk AND a.s BETWEEN x.s - {radius} AND x.s + {radius}), f) AS f, coalesce((SELECT max(ord) FROM at0 a WHERE a.user_id = x.user_id AND brk AND a.e BETWEEN x.e - {radius} AND x.e + {radius}), l) AS l, coalesce((SELECT arg_min(a.s, ord) FROM at0 a WHERE a.user_id = x.user_id AND brk AND a.s BETWEEN x.s - {radius} AND x.s + {radius}), x.s) AS s, coalesce((SELECT arg_max(a.e, ord) FROM at0 a WHERE a.user_id = x.user_id AND brk AND a.e BETWEEN x.e - {radius} AND x.e + {radius}), x.e) AS e FROM {source} x)"
_RESOLVE = "ro AS (SELECT *, lag(l) OVER (PARTITION BY user_id ORDER BY f, l) AS pl FROM sn), rs AS (SELECT ro.user_id, CASE WHEN f <= pl THEN pl + 1 ELSE f END AS nf, l, CASE WHEN f <= pl THEN coalesce(a.s, ro.s) ELSE ro.s END AS s, ro.e FROM ro LEFT JOIN at0 a ON a.user_id = ro.user_id AND a.ord = CASE WHEN f <= pl THEN pl + 1 ELSE f END WHERE CASE WHEN f <= pl THEN pl + 1 ELSE f END <= l)"
#: Greedy matches: in each step every user's best open pair, by overlap and ids.
_MATCH = f"""{_PAIR_SQL}, rk AS (SELECT user_id, p, t, iou, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, t, p) AS n FROM pairs),
state AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS ps, []::BIGINT[] AS ts, true AS hit FROM (SELECT DISTINCT user_id FROM rk)
UNION ALL SELECT user_id, n, CASE WHEN free THEN list_append(ps, p) ELSE ps END, CASE WHEN free THEN list_append(ts, t) ELSE ts END, free FROM (SELECT rk.*, s.ps, s.ts, NOT list_contains(s.ps, rk.p) AND NOT list_contains(s.ts, rk.t) AS free FROM state s JOIN rk ON rk.user_id = s.user_id AND rk.n = s.n + 1)),
matches AS (SELECT rk.* FROM state JOIN rk USING (user_id, n) WHERE hit)"""
_OUT = 'SELECT user_id, f AS first, l AS last, s AS "start", e AS "end"'
_SEGMENT_SQL = """t AS (SELECT conv_id, turn, role, length(coalesce(text, '')) / 15e0 AS l, ((turn * 7 + conv_id) % 20) / 10e0 AS q FROM conversations),
c AS (SELECT conv_id, turn, round(sum(l + q) OVER w - l, 3) AS s, round(sum(l + q) OVER w, 3) AS e, coalesce(role <> lag(role) OVER w, false) AS soft, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
walk AS (SELECT conv_id, turn, rn, s AS began, e, 0 AS seg FROM c WHERE rn = 1 UNION ALL SELECT c.conv_id, c.turn, c.rn, CASE WHEN c.s - walk.e >= 1.5e0 OR c.s - began >= 20 OR (soft AND walk.e - began >= 5) THEN c.s ELSE began END, c.e, CASE WHEN c.s - walk.e >= 1.5e0 OR c.s - began >= 20 OR (soft AND walk.e - began >= 5) THEN seg + 1 ELSE seg END FROM walk JOIN c ON c.conv_id = walk.conv_id AND c.rn = walk.rn + 1)"""
_LIVE = "z AS (SELECT user_id, s, e, round(u, 4) AS score, sum(CASE WHEN round(u, 4) < 0.45e0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS st FROM sp), y AS (SELECT *, max(score) OVER (PARTITION BY user_id, st ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS top0 FROM z), x AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 14400 THEN 0 ELSE 1 END AS new FROM y WHERE top0 >= 0.65e0 AND score >= 0.45e0), v AS (SELECT user_id, min(s) AS s, max(e) AS e, max(score) AS top FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x) GROUP BY user_id, g)"
_ISL = lambda where, extra="": f"(SELECT user_id, min(s) AS s, max(e) AS e{extra} FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sp WHERE {where})) GROUP BY user_id, g)"
_SHARE = lambda kind: f"coalesce((SELECT sum(least(a.e, i.e) - greatest(a.s, i.s)) FROM {kind} i WHERE i.user_id = a.user_id AND i.s < a.e AND a.s < i.e), 0) / (a.e - a.s)"

QUERIES = {
    "ev_match_optimal": (match_optimal, None),
    "ev_match_pairs": (match_pairs, f"WITH RECURSIVE {_MATCH} SELECT user_id, p, t, round(iou, 6) AS iou FROM matches"),
    "ev_fp_seconds": (fp_seconds, f"WITH {_COVER}, d AS (SELECT user_id, max(e) - min(s) AS duration FROM sp GROUP BY 1) SELECT user_id, CAST(over AS BIGINT) AS fp_seconds, round(over / (duration / 3600), 6) AS per_hour FROM cov JOIN d USING (user_id)"),
    "ev_gate": (gate, f"WITH RECURSIVE {_MATCH}, m AS (SELECT user_id, count(*) AS m, avg(err / 2) AS mean_error, max(err) AS max_error FROM (SELECT user_id, abs(ps - ts) + abs(pe - te) AS err FROM matches JOIN pairs USING (user_id, p, t) WHERE matches.iou >= 0.05e0) GROUP BY 1), c AS (SELECT user_id, count(*) FILTER (WHERE kind IN ('view', 'click')) AS np, count(*) FILTER (WHERE kind = 'purchase') AS nt FROM sp GROUP BY 1), r AS (SELECT user_id, round(CASE WHEN np = 0 AND nt = 0 THEN 1e0 WHEN np > 0 THEN coalesce(m, 0) / np ELSE 0e0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN coalesce(m, 0) / nt ELSE 1e0 END, 6) AS recall, coalesce(mean_error, 0) AS a, coalesce(max_error, 0) AS b FROM c LEFT JOIN m USING (user_id)) SELECT user_id, precision, recall, concat_ws(',', CASE WHEN precision < 0.1e0 THEN 'precision' END, CASE WHEN recall < 0.2e0 THEN 'recall' END, CASE WHEN a > 1500 THEN 'mean_error' END, CASE WHEN b > 6000 THEN 'max_error' END) AS reasons FROM r"),
    "ev_nine": (nine, f"WITH RECURSIVE {_MATCH}, x AS (SELECT pairs.* FROM matches JOIN pairs USING (user_id, p, t)), {_COVER[len(SPAN_SQL) + 2 :]} SELECT (SELECT count(*) FROM x) AS matched, (SELECT round(avg(iou), 6) FROM x) AS mean_iou, (SELECT quantile_cont(abs(ps - ts), 0.5) FROM x) AS start_error, (SELECT quantile_cont(abs(pe - te), 0.5) FROM x) AS end_error, (SELECT quantile_cont(ps - ts, 0.5) FROM x) AS start_bias, (SELECT quantile_cont(pe - te, 0.5) FROM x) AS end_bias, round(sum(cov.both) / sum(cov.both + missed), 6) AS coverage_recall, round(sum(cov.both) / sum(cov.both + over), 6) AS coverage_precision FROM cov"),
    "ev_fn_decomp": (fn_decomposition, f"WITH {SPAN_SQL}, st AS (SELECT user_id, s, e, kind = 'purchase' AS t, kind = 'click' AND k >= 40 AS c, kind IN ('view', 'click', 'signup') AS x, kind IN ('view', 'click', 'signup') AND k >= 40 AS g FROM sp WHERE e > s), pts AS (SELECT user_id, pt, sum(sign * t::INT) AS t, sum(sign * c::INT) AS c, sum(sign * x::INT) AS x, sum(sign * g::INT) AS g FROM (SELECT user_id, s AS pt, 1 AS sign, t, c, x, g FROM st UNION ALL SELECT user_id, e, -1, t, c, x, g FROM st) GROUP BY 1, 2), sw AS (SELECT lead(pt) OVER w - pt AS n, sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS t, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS c, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS x, sum(g) OVER (w ROWS UNBOUNDED PRECEDING) AS g FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY pt)) SELECT cause, CAST(coalesce(sum(n) FILTER (WHERE t > 0 AND c = 0 AND CASE cause WHEN 'pipelineCoverage' THEN x = 0 WHEN 'classifierRecall' THEN x > 0 AND g = 0 ELSE g > 0 END), 0) AS BIGINT) AS seconds FROM sw, (VALUES ('pipelineCoverage'), ('classifierRecall'), ('promotionRecall')) v(cause) GROUP BY 1"),
    "ev_ground_truth": (ground_truth, f"WITH {SPAN_SQL}, pr AS (SELECT * FROM sp WHERE kind = 'purchase' OR (kind = 'click' AND k >= 90)), tr AS (SELECT * FROM sp WHERE kind = 'error'), {_sweep('pr', 'tr')}, x AS (SELECT user_id, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sw WHERE e IS NOT NULL AND a > 0 AND b = 0) SELECT user_id, min(s) AS \"start\", max(e) AS \"end\" FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM x) WHERE user_id NOT IN (SELECT user_id FROM ev WHERE kind = 'error' AND k = 99) GROUP BY user_id, g"),
    "ev_delta": (delta, f"WITH {SPAN_SQL}, ci AS {_ISL(chr(39).join(['kind = ', 'click', '']))}, vi AS {_ISL(chr(39).join(['kind = ', 'view', '']))}, d AS (SELECT {_SHARE('ci')} AS b, {_SHARE('vi')} AS x FROM sp a WHERE kind = 'purchase' AND e > s) SELECT CASE WHEN b > 0 AND x = 0 THEN 'FUSION_DROP' WHEN x < b THEN 'CAND_NARROW' ELSE 'OK' END AS verdict, count(*) AS n, round(avg(x - b), 6) AS mean_delta FROM d GROUP BY 1"),
    "ev_edge_margin": (edge_margin, f"WITH {_PAIR_SQL} SELECT user_id, count(*) AS n, round(quantile_cont(ps - ts, 0.05), 3) AS low, round(quantile_cont(ps - ts, 0.95), 3) AS high, CASE WHEN count(*) FILTER (WHERE ps - ts < -10800) = 0 THEN round(1 - pow(0.05e0, 1e0 / count(*)), 6) END AS bound FROM pairs GROUP BY 1"),
    "ev_gold_score": (gold_score, f"WITH {SPAN_SQL}, ci AS {_ISL(chr(39).join(['kind IN (', 'view', ', ', 'click', ')']))}, d AS (SELECT a.user_id, {_SHARE('ci')} AS x FROM sp a WHERE kind = 'purchase' AND e > s) SELECT user_id, count(*) AS n, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90 FROM d GROUP BY 1"),
    "ev_materialize": (materialized, f"WITH {SPAN_SQL}, g AS (SELECT user_id, s // 86400 AS day, count(*) AS scans, min(ord) FILTER (WHERE kind = 'click') AS first, max(ord) FILTER (WHERE kind = 'click') AS last, arg_max(event_id, k * 100000000 + event_id) FILTER (WHERE kind = 'purchase') AS decision, count(*) FILTER (WHERE kind = 'error') AS corrections FROM sp GROUP BY 1, 2) SELECT user_id, day, scans, first, last, decision, CASE WHEN corrections > 0 AND decision IS NOT NULL THEN 'disagreement' WHEN decision IS NOT NULL THEN 'positive' WHEN first IS NULL THEN 'uncertain' ELSE 'negative' END AS bucket FROM g"),
    "ev_replay": (replay, f"WITH {SPAN_SQL}, i AS {_ISL(chr(39).join(['kind = ', 'click', ' OR (kind = ', 'view', ' AND user_id % 2 = 0)']))} SELECT user_id, CAST(sum(e - s) AS BIGINT) AS covered FROM i GROUP BY 1"),
    "ev_music_eval": (music_eval, f"WITH {SPAN_SQL}, g AS (SELECT user_id, unnest([s, e]) AS x FROM sp WHERE kind = 'purchase') SELECT kind, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.user_id = a.user_id AND abs(g.x - a.s) <= 1800) THEN 1e0 ELSE 0e0 END), 6) AS precision FROM sp a WHERE kind <> 'purchase' GROUP BY 1"),
    "ev_platt_fit": (platt, None),
    "set_fm_cluster": (fm_clusters, f"WITH RECURSIVE {SPAN_SQL}, vw AS (SELECT * FROM sp WHERE kind = 'view'), e0 AS (SELECT a.event_id AS a, b.event_id AS b FROM vw a JOIN vw b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s < b.e AND b.s < a.e AND (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) >= 0.4e0), reach AS (SELECT event_id AS a, event_id AS z FROM vw UNION SELECT reach.a, e0.b FROM reach JOIN e0 ON e0.a = reach.z), c AS (SELECT a, min(z) AS cluster FROM reach GROUP BY 1) SELECT cluster, count(*) AS n, min(s) AS \"start\", max(e) AS \"end\", CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS strength FROM vw JOIN c ON c.a = vw.event_id GROUP BY 1"),
    "set_union_sources": (union_sources, f"WITH {SPAN_SQL} SELECT user_id, s AS \"start\", e AS \"end\", n_view, n_click, n_purchase, n_signup, n_error FROM " + _ISL("true", "".join(f", count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("view", "click", "purchase", "signup", "error")))),
    "win_form_runs": (runs, f"WITH {_ATOM_SQL} {_OUT} FROM runs"),
    "win_merge_adjacent": (merge_adjacent, f"WITH {_ATOM_SQL}, {_MERGED} {_OUT} FROM merged"),
    "win_split_long": (split_long, f"WITH RECURSIVE {_ATOM_SQL}, {_MERGED}, {_SPLIT} {_OUT} FROM split"),
    "win_snap": (snapped, f"WITH {_ATOM_SQL}, {_SNAP('runs', 28800)} {_OUT} FROM sn"),
    "win_resolve_overlap": (resolved, f"WITH {_ATOM_SQL}, {_SNAP('runs', 28800)}, {_RESOLVE} SELECT user_id, nf AS first, l AS last, s AS \"start\", e AS \"end\" FROM rs"),
    "win_decode": (decoded, f"WITH RECURSIVE {_ATOM_SQL}, {_MERGED}, {_SPLIT}, {_SNAP('split', 14400)}, {_RESOLVE} SELECT user_id, nf AS first, l AS last, s AS \"start\", e AS \"end\" FROM rs WHERE e - s >= 3600"),
    "win_segment": (segmented, f"WITH RECURSIVE {_SEGMENT_SQL} SELECT conv_id, turn, CAST(seg AS BIGINT) AS segment FROM walk"),
    "win_hysteresis_segments": (hysteresis, None),
    "st_hypothesis": (hypotheses, None),
    "win_finalize": (finalized, None),
    "st_hysteresis_live": (live_skips, f"WITH {SPAN_SQL}, {_LIVE} SELECT user_id, s AS \"start\", e AS \"end\", top FROM v WHERE e - s >= 3600 OR top >= 0.85e0"),
    "win_boundary_resolve": (boundary_resolve, f"WITH {SPAN_SQL}, n AS (SELECT a.user_id, a.event_id AS id, b.s AS tm, abs(b.s - a.s) AS d, round(CASE WHEN b.kind = 'view' THEN 0.4e0 ELSE 0.6e0 END * b.u * (1 - abs(b.s - a.s) / 10800), 9) AS score FROM sp a JOIN sp b ON a.user_id = b.user_id AND b.kind IN ('view', 'click') AND abs(b.s - a.s) <= 10800 WHERE a.kind = 'purchase'), t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, d, tm) = 1) SELECT sp.user_id, sp.event_id AS id, t.tm AS snapped, round(t.score, 6) AS score FROM sp LEFT JOIN t ON t.id = sp.event_id WHERE kind = 'purchase'"),
    "win_boundary_expand": (boundary_expand, f"WITH {SPAN_SQL}, w AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS l, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS r FROM sp), h AS (SELECT *, (SELECT arg_min([b.s, b.e], b.s * 100000000 + (b.e - b.s)) FROM sp b WHERE b.user_id = w.user_id AND b.kind = 'purchase' AND w.s < b.e AND b.s <= w.s) AS h FROM w WHERE kind = 'error') SELECT event_id, coalesce(h[1], CASE WHEN s - l <= 7200 THEN l END, s - 1800) AS \"from\", coalesce(h[2], CASE WHEN r - s <= 7200 THEN r END, s + 1800) AS \"to\" FROM h"),
}
