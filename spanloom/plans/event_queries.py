"""Queries over ``events``: a user's events as spans and signals. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import rollups, scoring

SECOND = 1_000_000
HOUR, DAY = 3600 * SECOND, 86_400 * SECOND
WEIGHTS = {"signup": 1.2, "purchase": 0.9, "click": 0.8, "view": 0.3, "error": -0.5}
_USER = ["user_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def spans(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """An event covers as many minutes as its value, from its time on."""
    rows = events(spark, sf_dir)
    rows = rows.where(F.col("event_type").isin(*kinds)) if kinds else rows
    return rows.select("user_id", "event_id", "event_type", F.col("at").alias("start"), (F.col("at") + F.floor(F.col("value") * 60).cast("long") * SECOND).alias("end"), F.least(F.floor("value") / 100, F.lit(1.0)).alias("confidence"))


_SPANS = "spans AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e, least(floor(value) / 100, 1.0) AS confidence FROM events)"


def _islands(source: str, gap: int = 0, extra: str = "") -> str:
    """Islands of a CTE with user_id, s and e."""
    return f"""SELECT user_id, min(s) AS "start", max(e) AS "end"{extra} FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY user_id, island"""


_A, _B = ("view", "click"), ("purchase",)
_SWEEP = f"""{_SPANS}, points AS (SELECT user_id, pt, sum(da) AS da, sum(db) AS db FROM (
SELECT user_id, s AS pt, 1 AS da, 0 AS db FROM spans WHERE event_type IN ('view', 'click') UNION ALL SELECT user_id, e, -1, 0 FROM spans WHERE event_type IN ('view', 'click')
UNION ALL SELECT user_id, s, 0, 1 FROM spans WHERE event_type = 'purchase' UNION ALL SELECT user_id, e, 0, -1 FROM spans WHERE event_type = 'purchase') GROUP BY user_id, pt),
swept AS (SELECT user_id, pt AS s, lead(pt) OVER w AS e, sum(da) OVER (w ROWS UNBOUNDED PRECEDING) AS a, sum(db) OVER (w ROWS UNBOUNDED PRECEDING) AS b FROM points WINDOW w AS (PARTITION BY user_id ORDER BY pt))"""


def merge_events(spark, sf_dir):
    return iv.merge(spans(spark, sf_dir).withColumn("n", F.lit(1).cast("long")), _USER, gap=HOUR, sums=["n"], bucket=DAY)


def union_length(spark, sf_dir):
    return iv.union_length(spans(spark, sf_dir), _USER, bucket=DAY)


def subtract(spark, sf_dir):
    return iv.subtract(spans(spark, sf_dir, *_A), spans(spark, sf_dir, *_B), _USER)


def intersect(spark, sf_dir):
    return iv.intersect(spans(spark, sf_dir, *_A), spans(spark, sf_dir, *_B), _USER)


def _pairs(spark, sf_dir):
    return iv.overlap_join(spans(spark, sf_dir, *_A), spans(spark, sf_dir, *_B), _USER, bucket=6 * HOUR)


_PAIRS = f"{_SPANS}, pairs AS (SELECT a.user_id, a.event_id AS p, b.event_id AS t, least(a.e, b.e) - greatest(a.s, b.s) AS shared, greatest(a.e, b.e) - least(a.s, b.s) AS whole FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type IN ('view', 'click') AND b.event_type = 'purchase')"


def overlap_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("user_id", F.col("a.event_id").alias("p"), F.col("b.event_id").alias("t"), iv.overlap_length().alias("shared"))


def interval_iou(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("a.event_id").alias("p"), F.col("b.event_id").alias("t"), F.round(iv.iou(), 6).alias("iou"))


def match_greedy(spark, sf_dir):
    scored = _pairs(spark, sf_dir).select("user_id", F.col("a.event_id").alias("p"), F.col("b.event_id").alias("t"), F.round(iv.iou(), 9).alias("iou"))
    return scoring.match_greedy(scored, _USER).select("user_id", "p", "t", F.round("iou", 6).alias("iou"))


def point_in_interval(spark, sf_dir):
    """Left join: how many spans of B hold each error's time (closed ends)."""
    points = events(spark, sf_dir).where("event_type = 'error'").select("user_id", "event_id", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    wide = spans(spark, sf_dir, *_B).withColumn("end", F.col("end") + 1)
    held = iv.overlap_join(points, wide, _USER, bucket=6 * HOUR).groupBy(F.col("a.event_id").alias("event_id")).agg(F.count("*").alias("n"))
    return points.join(held, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


def asof_forward(spark, sf_dir):
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'view'").select("user_id", "event_id", "at")
    return iv.asof_forward(left, rows.where("event_type = 'purchase'"), _USER, within=DAY).select("event_id", "user_id", "at", "next_at")


def false_ready_rate(spark, sf_dir):
    """Share of views that no purchase follows within a day."""
    found = asof_forward(spark, sf_dir)
    return found.agg(F.count("*").alias("ready"), F.sum(F.col("next_at").isNull().cast("long")).alias("not_followed"), F.round(F.avg(F.col("next_at").isNull().cast("double")), 6).alias("rate"))


def gap_group_score(spark, sf_dir):
    weight = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(w)) for k, w in WEIGHTS.items()))
    hits = events(spark, sf_dir).select("user_id", F.col("at").alias("start"), F.col("at").alias("end"), weight.alias("weight"))
    return scoring.hit_groups(hits, _USER, gap=6 * HOUR)


def regularize(spark, sf_dir):
    rows = spans(spark, sf_dir).withColumnRenamed("event_id", "id")
    return scoring.regularize(rows, _USER, near=HOUR, short=600 * SECOND).select("user_id", "id", "confidence")


def local_maxima(spark, sf_dir):
    return scoring.local_maxima(events(spark, sf_dir), _USER, ["at", "event_id"], "value").select("event_id", "user_id", "value")


def energy_transitions(spark, sf_dir):
    level = events(spark, sf_dir).withColumn("level", F.col("value") / 100)
    return scoring.transitions(level, _USER, ["at", "event_id"], "level", loud=0.05, step=0.25, share=0.35).select("event_id", "kind")


def spikes(spark, sf_dir):
    return scoring.spikes(events(spark, sf_dir), _USER, "value").select("event_id", "user_id", F.round("p", 6).alias("p"))


def smooth(spark, sf_dir):
    return scoring.smooth(events(spark, sf_dir), _USER, ["at", "event_id"], "value").select("event_id", "smoothed")


def pi_control(spark, sf_dir):
    signals = events(spark, sf_dir).withColumn("error", (F.when(F.col("event_type") == "error", -1).otherwise(1) * F.least(F.floor("value"), F.lit(100)) / 100).cast("decimal(12,2)"))
    return scoring.pi_control(signals, _USER, ["at", "event_id"], "error").select("event_id", F.col("offset").cast("double").alias("offset"))


def rolled_up(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rollups.suppressed_rollup(rows, ["day", "event_type"], "user_id", ["k"], k=20)


def _counters(spark, sf_dir, until: str):
    return events(spark, sf_dir).where(F.col("ts") < F.lit(until).cast("timestamp")).groupBy("user_id").agg(F.count("*").alias("n"))


def counter_delta(spark, sf_dir):
    return rollups.counter_delta(_counters(spark, sf_dir, "2024-01-20"), _counters(spark, sf_dir, "2024-01-10"), "user_id")


def counter_merge(spark, sf_dir):
    rows = events(spark, sf_dir)
    sides = (rows.where(F.col("event_type") == k).groupBy("user_id").agg(F.count("*").alias("n")) for k in ("view", "click"))
    return rollups.counter_merge(*sides, "user_id")


def lru_evict(spark, sf_dir):
    return rollups.newest(events(spark, sf_dir), ["user_id", "event_type"], [F.desc("at"), F.desc("event_id")], 3).select("user_id", "event_type", "event_id")


def retention(spark, sf_dir):
    return rollups.retention(events(spark, sf_dir).withColumn("day", F.to_date("ts")), "user_id", "day", (1, 7, 28))


def covered_seconds(spark, sf_dir):
    """Second-level precision and recall of views and clicks (predicted) against purchases (truth), by user.

    Whole-second ends make the set of seconds a union length: no second is ever listed.
    """
    whole = lambda df: df.withColumn("start", F.floor(F.col("start") / SECOND)).withColumn("end", F.ceil(F.col("end") / SECOND))
    swept = iv.sweep(whole(spans(spark, sf_dir, *_A)), whole(spans(spark, sf_dir, *_B)), _USER)
    length = F.col("end") - F.col("start")
    part = lambda c: F.sum(F.when(F.expr(c), length).otherwise(0))
    counts = swept.groupBy("user_id").agg(part("in_a > 0 AND in_b > 0").alias("tp"), part("in_a > 0 AND in_b = 0").alias("fp"), part("in_a = 0 AND in_b > 0").alias("fn"))
    return counts.withColumn("f1", F.round(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), 6))


def runs(spark, sf_dir):
    """Runs of consecutive turns whose text has twelve words or more."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return iv.consecutive_runs(turns, ["conv_id"], "turn", F.size(F.split("text", " ")) >= 12)


_ORDER = "(PARTITION BY user_id ORDER BY ts, event_id)"

QUERIES = {
    "ivl_merge_events": (merge_events, f"WITH {_SPANS}" + _islands("spans", HOUR, ", CAST(count(*) AS BIGINT) AS n")),
    "ivl_union_length": (union_length, f'WITH {_SPANS}, merged AS ({_islands("spans")}) SELECT user_id, CAST(sum("end" - "start") AS BIGINT) AS covered FROM merged GROUP BY user_id'),
    "ivl_subtract": (subtract, f"WITH {_SWEEP}" + _islands("(SELECT * FROM swept WHERE e IS NOT NULL AND a > 0 AND b = 0)")),
    "ivl_intersect": (intersect, f"WITH {_SWEEP}" + _islands("(SELECT * FROM swept WHERE e IS NOT NULL AND a > 0 AND b > 0)")),
    "ivl_overlap_join": (overlap_pairs, f"WITH {_PAIRS} SELECT user_id, p, t, shared FROM pairs"),
    "ivl_iou": (interval_iou, f"WITH {_PAIRS} SELECT p, t, round(greatest(shared, 0) / whole, 6) AS iou FROM pairs"),
    "ev_match_greedy": (match_greedy, f"WITH {_PAIRS}, scored AS (SELECT user_id, p, t, round(greatest(shared, 0) / whole, 9) AS iou FROM pairs), claims AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY user_id, p ORDER BY iou DESC, t) = 1), kept AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY iou DESC, p) = 1) SELECT user_id, p, t, round(iou, 6) AS iou FROM kept"),
    "join_point_in_interval": (point_in_interval, f"WITH {_SPANS} SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN spans b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND epoch_us(a.ts) BETWEEN b.s AND b.e WHERE a.event_type = 'error' GROUP BY a.event_id"),
    "join_asof_forward": (asof_forward, "SELECT a.event_id, a.user_id, epoch_us(a.ts) AS at, (SELECT min(epoch_us(b.ts)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000) AS next_at FROM events a WHERE a.event_type = 'view'"),
    "false_ready_rate": (false_ready_rate, "WITH f AS (SELECT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 86400000000) AS ok FROM events a WHERE a.event_type = 'view') SELECT count(*) AS ready, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS not_followed, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 6) AS rate FROM f"),
    "win_gap_group_score": (gap_group_score, "WITH hits AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) AS e, CASE event_type WHEN 'signup' THEN 120 WHEN 'purchase' THEN 90 WHEN 'click' THEN 80 WHEN 'view' THEN 30 ELSE -50 END AS w FROM events), g AS (" + _islands("(SELECT * FROM hits WHERE w >= 0)", 6 * HOUR, ", count(*) AS n_hits, sum(w) AS w, sum(CASE WHEN w >= 95 THEN 1 ELSE 0 END) AS strong") + f'), t AS (SELECT g.*, w + coalesce((SELECT sum(h.w) FROM hits h WHERE h.user_id = g.user_id AND h.w < 0 AND h.s <= g."end" + {6 * HOUR} AND h.e >= g."start" - {6 * HOUR}), 0) AS total FROM g) SELECT user_id, "start", "end", n_hits, round(least(0.95::DOUBLE, 1 - 1 / (1 + 0.3::DOUBLE * greatest(total, 0) / 100.0)), 6) AS score FROM t WHERE n_hits >= 2 OR strong >= 1'),
    "win_regularize": (regularize, f"WITH {_SPANS}, m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, EXISTS (SELECT 1 FROM spans b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id AND b.confidence >= 0.8 AND ((b.s < a.s OR (b.s = a.s AND b.event_id < a.event_id)) AND a.s - b.e <= 3600000000 OR (b.s > a.s OR (b.s = a.s AND b.event_id > a.event_id)) AND b.s - a.e <= 3600000000)) AS backed FROM spans a) SELECT user_id, event_id AS id, round(confidence * CASE WHEN n = 1 OR backed THEN 1.0::DOUBLE WHEN e - s < 600000000 THEN 0.85::DOUBLE * 0.9::DOUBLE ELSE 0.85::DOUBLE END, 6) AS confidence FROM m"),
    "win_local_maxima": (local_maxima, f"SELECT event_id, user_id, value FROM (SELECT *, lag(value) OVER {_ORDER} AS l, lead(value) OVER {_ORDER} AS r FROM events) WHERE (l IS NULL OR value >= l) AND (r IS NULL OR value >= r)"),
    "win_energy_transition": (energy_transitions, f"SELECT event_id, CASE WHEN v > b THEN 'rise' ELSE 'drop' END AS kind FROM (SELECT event_id, value / 100 AS v, lag(value / 100) OVER {_ORDER} AS b FROM events) WHERE b IS NOT NULL AND greatest(v, b) >= 0.05::DOUBLE AND abs(v - b) >= 0.25::DOUBLE AND abs(v - b) / greatest(v, b) > 0.35::DOUBLE"),
    "win_spike": (spikes, "SELECT event_id, user_id, round(p, 6) AS p FROM events JOIN (SELECT user_id, quantile_cont(value, 0.8) AS p FROM events GROUP BY user_id) USING (user_id) WHERE value > 2 * p"),
    "win_smooth_kernel": (smooth, f"SELECT event_id, round((coalesce(l, 0) + 2 * value + coalesce(r, 0)) / (2 + CASE WHEN l IS NULL THEN 0 ELSE 1 END + CASE WHEN r IS NULL THEN 0 ELSE 1 END), 6) AS smoothed FROM (SELECT *, lag(value) OVER {_ORDER} AS l, lead(value) OVER {_ORDER} AS r FROM events)"),
    "st_pi_control": (pi_control, f"WITH e AS (SELECT *, CAST(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * least(floor(value), 100) / 100 AS DECIMAL(12,2)) AS err FROM events), f AS (SELECT event_id, err, sum(err) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT event_id, round(CASE WHEN n < 5 THEN 0.0::DOUBLE ELSE greatest(-0.15::DOUBLE, least(0.15::DOUBLE, 0.02::DOUBLE * err::DOUBLE + 0.005::DOUBLE * total::DOUBLE)) END, 6) AS \"offset\" FROM f"),
    "agg_kanon_rollup": (rolled_up, "SELECT day, event_type, count(DISTINCT user_id) AS members, CASE WHEN count(DISTINCT user_id) >= 20 THEN CAST(sum(k) AS BIGINT) END AS k FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ROLLUP (day, event_type)"),
    "agg_counter_delta": (counter_delta, "SELECT user_id, delta FROM (SELECT user_id, count(*) - count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS delta FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id) WHERE delta > 0"),
    "agg_counter_merge": (counter_merge, "SELECT user_id, greatest(count(*) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type = 'click')) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id"),
    "topk_lru_evict": (lru_evict, "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 3"),
    "dt_retention": (retention, "SELECT count(*) AS users, CAST(sum(CASE WHEN g >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS d1, CAST(sum(CASE WHEN g >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS d7, CAST(sum(CASE WHEN g >= 28 THEN 1 ELSE 0 END) AS BIGINT) AS d28 FROM (SELECT user_id, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS g FROM events GROUP BY user_id)"),
    "ev_seconds": (covered_seconds, f"WITH {_SPANS}, sec AS (SELECT DISTINCT user_id, event_type = 'purchase' AS truth, unnest(generate_series(CAST(floor(s / 1000000) AS BIGINT), CAST(ceil(e / 1000000) AS BIGINT) - 1)) AS x FROM spans WHERE event_type IN ('view', 'click', 'purchase')), c AS (SELECT user_id, x, bool_or(truth) AS t, bool_or(NOT truth) AS p FROM sec GROUP BY user_id, x), k AS (SELECT user_id, CAST(count(*) FILTER (WHERE t AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE p AND NOT t) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE t AND NOT p) AS BIGINT) AS fn FROM c GROUP BY user_id) SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k"),
    "win_runs": (runs, "SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE len(string_split(text, ' ')) >= 12)) GROUP BY conv_id, run"),
}
