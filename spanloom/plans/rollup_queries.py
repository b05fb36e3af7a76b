"""Queries of the aggregates, over events, documents and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import scores as sc
from spanloom.operators import rollups as ru
from spanloom.plans.common import EVENT_SQL, events, pick, pick_sql, table

_DAY = 86_400_000_000


def throughput_split(spark, sf_dir):
    """Price by quantity for each phase of a line; lines of promotional parts are sentinels and stay out."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").where("p_type IS NULL OR p_type NOT LIKE 'PROMO%'")
    phase = F.when(F.col("l_returnflag").isin("A", "R"), "foreground").when(F.col("l_returnflag") == "N", "background").otherwise("unattributed")
    each = lines.groupBy(phase.alias("phase")).agg(F.count("*").alias("scans"), F.sum("l_quantity").alias("audio"), F.sum("l_extendedprice").alias("wall"))
    return each.select("phase", "scans", F.round("audio").alias("audio"), F.round(F.col("wall") / F.nullif("audio", F.lit(0.0)), 2).alias("ratio"))


def headline(spark, sf_dir):
    """Two levels: each order's share of lines shipped before 1997, and what the orders' shares come to."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((100.0 * F.avg((F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).cast("double"))).alias("pct"))
    each = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return each.agg(F.count("*").alias("episodes"), F.count_if(F.col("pct") >= 95).alias("fully"), F.count_if(F.col("pct").isNull() | (F.col("pct") < 25)).alias("under25"), F.round(F.avg(F.coalesce("pct", F.lit(0.0))), 4).alias("mean_pct"))


def weighted_avg(spark, sf_dir):
    """Discount by supplier, weighted by quantity; 0 without weight."""
    weight = F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.when(weight > 0, F.sum(F.col("l_discount") * F.col("l_quantity")) / weight).otherwise(0.0), 6).alias("average"))


def duration_range(spark, sf_dir):
    return ru.duration_range(events(spark, sf_dir), ["user_id"], "v").select("user_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


def clusters(spark, sf_dir):
    """Each kind's clusters of scores, rounded to hundredths, weighted by count."""
    rows = events(spark, sf_dir).select("kind", F.round("u", 2).alias("x"), F.lit(1).alias("w"))
    return ru.clusters(rows, ["kind"], "x", "w", radius=0.05).select("kind", F.round("centroid", 6).alias("centroid"), F.col("weight").cast("long").alias("weight"))


def welford(spark, sf_dir):
    return ru.running_spread(events(spark, sf_dir).withColumn("day", F.floor(F.col("at") / _DAY)), ["user_id", "day"], "v").select("user_id", "day", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "n")


def duration_stats(spark, sf_dir):
    """Stats by day merged into stats by user: what can be added up is."""
    day = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("at") / _DAY).alias("day")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return day.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def atlas(spark, sf_dir):
    """Kinds by how many of a user's ten newest days have them."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("at") / _DAY))
    return ru.newest_mentions(rows, "user_id", "day", "day", "kind", cap=10)


def op_metrics(spark, sf_dir):
    """Additive counters by user and their rates, null without a denominator."""
    one = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long"))
    each = events(spark, sf_dir).groupBy("user_id").agg(one("view").alias("shown"), one("click").alias("clicked"), one("purchase").alias("bought"), one("error").alias("failed"))
    return each.select("*", F.round(F.try_divide("clicked", "shown"), 6).alias("click_rate"), F.round(F.try_divide("failed", F.col("shown") + F.col("clicked")), 6).alias("failure_rate"))


def metric_slices(spark, sf_dir):
    rows = events(spark, sf_dir).withColumns({"band": F.floor(F.col("k") / 25), "day": F.floor(F.col("at") / _DAY)})
    return ru.sliced(rows, ["kind", "band", "day"], {"n": F.lit(1), "total_k": F.col("k")})


def medians(spark, sf_dir):
    """The upper and the averaged median of each user's values, and their spread as a population."""
    return events(spark, sf_dir).groupBy("user_id").agg(ru.upper_median("v").alias("upper"), F.round(F.median("v"), 6).alias("averaged"))


def stddev(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(F.stddev_pop("v"), 6).alias("sigma"))


def hit_rates(spark, sf_dir):
    since = F.lit("2024-01-16").cast("timestamp").cast("long") * 1_000_000
    return ru.hit_rate(events(spark, sf_dir), ["user_id"], "at", since, F.col("kind") == "purchase", 20, 0.2).select("user_id", "samples", "hits", F.round("rate", 6).alias("rate"), "disabled")


def sli_cohorts(spark, sf_dir):
    """Mean value by metric and four axes, in the cells that mean something."""
    axes = {"trigger": pick(F.col("k"), ("explicit", "auto")), "mode": F.when(F.col("k") % 5 > 0, "available").otherwise("unavailable"), "condition": pick(F.floor(F.col("k") / 2), ("favorable", "mixed", "constrained")), "bucket": sc.duration_bucket(F.col("v") * 60)}
    cells = events(spark, sf_dir).groupBy("kind", *(c.alias(n) for n, c in axes.items())).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    middle = F.col("bucket").isin("to60m", "to90m")
    meaningful = F.when(F.col("kind") == "view", (F.col("trigger") == "explicit") & middle).when(F.col("kind") == "click", (F.col("trigger") == "explicit") & (F.col("mode") == "available") & middle).when(F.col("kind") == "error", F.col("mode") == "available").otherwise(True)
    return cells.where(meaningful)


def r3_distribution(spark, sf_dir):
    """Closest-rank quartiles of each source's document lengths, and the largest document's share."""
    each = table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    order = ru.Window.partitionBy("source").orderBy("n_chars")
    ranked = each.withColumn("hi", F.sum("c").over(order.rowsBetween(ru.Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(ru.Window.partitionBy("source")))
    at = lambda p: F.min(F.when(F.col("hi") > F.rint(p * (F.col("n") - 1)), F.col("n_chars")))
    return ranked.groupBy("source").agg(at(0.25).alias("p25"), at(0.75).alias("p75"), F.round(F.max("n_chars") / F.sum(F.col("n_chars") * F.col("c")), 6).alias("top_share"))


def unplayed(spark, sf_dir):
    """Orders by customer that are still open; customers without any count 0."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("unplayed"))


def storage(spark, sf_dir):
    """Characters by source against a cap of a fifth of all."""
    each = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"), F.count("*").alias("n"))
    total = each.agg(F.sum("size").alias("all"))
    return each.join(F.broadcast(total)).select("source", "size", "n", (5 * F.col("size") > F.col("all")).alias("over"))


def kanon_rate(spark, sf_dir):
    """Suppressed cohort sums with a rate by hour of the cohort's seconds."""
    rows = events(spark, sf_dir).select("kind", "user_id", F.floor(F.col("v") * 60).alias("seconds"), (F.col("k") >= 50).cast("long").alias("reaches"))
    cells = ru.suppressed_rollup(rows, ["kind"], "user_id", ["reaches", "seconds"], k=20)
    return cells.withColumn("per_hour", F.round(F.try_divide(F.col("reaches"), F.col("seconds") / 3600), 6))


QUERIES = {
    "agg_throughput_split": (throughput_split, "SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'foreground' WHEN l_returnflag = 'N' THEN 'background' ELSE 'unattributed' END AS phase, count(*) AS scans, round(sum(l_quantity)) AS audio, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 2) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NULL OR p_type NOT LIKE 'PROMO%' GROUP BY 1"),
    "agg_headline": (headline, "WITH l AS (SELECT l_orderkey, 100.0e0 * avg(CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 1e0 ELSE 0e0 END) AS pct FROM lineitem GROUP BY 1) SELECT count(*) AS episodes, count(*) FILTER (WHERE pct >= 95) AS fully, count(*) FILTER (WHERE pct IS NULL OR pct < 25) AS under25, round(avg(coalesce(pct, 0)), 4) AS mean_pct FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"),
    "agg_weighted_avg": (weighted_avg, "SELECT l_suppkey, round(coalesce(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 0), 6) AS average FROM lineitem GROUP BY 1"),
    "agg_range": (duration_range, f"WITH {EVENT_SQL}, r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev), t AS (SELECT user_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM r WHERE r > CASE WHEN n >= 4 THEN greatest(1, floor(n * 0.1e0)) ELSE 0 END AND r <= n - CASE WHEN n >= 4 THEN greatest(1, floor(n * 0.1e0)) ELSE 0 END GROUP BY 1) SELECT user_id, round(CASE WHEN hi - lo < 10 THEN (lo + hi) / 2 - 5 ELSE lo END, 6) AS low, round(CASE WHEN hi - lo < 10 THEN (lo + hi) / 2 + 5 ELSE hi END, 6) AS high, n FROM t"),
    "agg_cluster_1d": (clusters, None),
    "agg_welford": (welford, f"WITH {EVENT_SQL} SELECT user_id, tm // 86400000000 AS day, round(avg(v), 6) AS mean, round(CASE WHEN count(*) > 1 THEN greatest(stddev_samp(v), 0.1e0) ELSE 2e0 END, 6) AS spread, count(*) AS n FROM ev GROUP BY 1, 2"),
    "agg_duration_stats": (duration_stats, f"WITH {EVENT_SQL} SELECT user_id, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high FROM ev GROUP BY 1"),
    "agg_atlas": (atlas, f"WITH {EVENT_SQL}, d AS (SELECT DISTINCT user_id, tm // 86400000000 AS day FROM ev QUALIFY dense_rank() OVER (PARTITION BY user_id ORDER BY tm // 86400000000 DESC) <= 10) SELECT user_id, kind, count(DISTINCT day) AS n FROM ev JOIN d USING (user_id) WHERE tm // 86400000000 = d.day GROUP BY 1, 2"),
    "agg_op_metrics": (op_metrics, "WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS shown, count(*) FILTER (WHERE event_type = 'click') AS clicked, count(*) FILTER (WHERE event_type = 'purchase') AS bought, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1) SELECT *, round(clicked / nullif(shown, 0), 6) AS click_rate, round(failed / nullif(shown + clicked, 0), 6) AS failure_rate FROM c"),
    "agg_metrics_slices": (metric_slices, f"WITH {EVENT_SQL}, s AS (SELECT 'all' AS dimension, 'all' AS value, k FROM ev UNION ALL SELECT 'kind', kind, k FROM ev UNION ALL SELECT 'band', CAST(k // 25 AS VARCHAR), k FROM ev UNION ALL SELECT 'day', CAST(tm // 86400000000 AS VARCHAR), k FROM ev) SELECT dimension, value, count(*) AS n, CAST(sum(k) AS BIGINT) AS total_k FROM s GROUP BY 1, 2"),
    "agg_median_two_flavours": (medians, f"WITH {EVENT_SQL} SELECT user_id, list_extract(list_sort(list(v)), CAST(count(*) // 2 + 1 AS INTEGER)) AS upper, round(median(v), 6) AS averaged FROM ev GROUP BY 1"),
    "agg_stddev_pop": (stddev, f"WITH {EVENT_SQL} SELECT user_id, round(stddev_pop(v), 6) AS sigma FROM ev GROUP BY 1"),
    "agg_hit_rate": (hit_rates, "WITH c AS (SELECT user_id, count(*) AS samples, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events WHERE ts > TIMESTAMP '2024-01-16' GROUP BY 1) SELECT user_id, samples, hits, round(hits / samples, 6) AS rate, samples >= 20 AND hits / samples < 0.2e0 AS disabled FROM c"),
    "agg_sli_cohort": (sli_cohorts, f"WITH {EVENT_SQL}, c AS (SELECT kind, {pick_sql('k', ('explicit', 'auto'))} AS trigger, CASE WHEN k % 5 > 0 THEN 'available' ELSE 'unavailable' END AS mode, {pick_sql('k // 2', ('favorable', 'mixed', 'constrained'))} AS condition, CASE WHEN v * 60 < 1800 THEN 'under30m' WHEN v * 60 <= 3600 THEN 'to60m' WHEN v * 60 <= 5400 THEN 'to90m' ELSE 'over90m' END AS bucket, v FROM ev) SELECT kind, trigger, mode, condition, bucket, count(*) AS n, round(avg(v), 6) AS mean FROM c WHERE CASE kind WHEN 'view' THEN trigger = 'explicit' AND bucket IN ('to60m', 'to90m') WHEN 'click' THEN trigger = 'explicit' AND mode = 'available' AND bucket IN ('to60m', 'to90m') WHEN 'error' THEN mode = 'available' ELSE true END GROUP BY ALL"),
    "agg_r3_distribution": (r3_distribution, "WITH s AS (SELECT source, list_sort(list(n_chars)) AS x, sum(n_chars) AS total FROM documents GROUP BY 1) SELECT source, x[CAST(round_even(0.25e0 * (len(x) - 1), 0) AS INTEGER) + 1] AS p25, x[CAST(round_even(0.75e0 * (len(x) - 1), 0) AS INTEGER) + 1] AS p75, round(list_max(x) / total, 6) AS top_share FROM s"),
    "agg_unplayed": (unplayed, "SELECT c_custkey, count(o_orderkey) AS unplayed FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1"),
    "agg_storage": (storage, "SELECT source, CAST(sum(n_chars) AS BIGINT) AS size, count(*) AS n, 5 * sum(n_chars) > (SELECT sum(n_chars) FROM documents) AS over FROM documents GROUP BY 1"),
    "agg_kanon_rate": (kanon_rate, f"WITH {EVENT_SQL}, c AS (SELECT kind, count(DISTINCT user_id) AS members, count(*) FILTER (WHERE k >= 50) AS reaches, CAST(sum(floor(v * 60)) AS BIGINT) AS seconds FROM ev GROUP BY ROLLUP (kind)) SELECT kind, members, CASE WHEN members >= 20 THEN reaches END AS reaches, CASE WHEN members >= 20 THEN seconds END AS seconds, CASE WHEN members >= 20 THEN round(reaches / (seconds / 3600), 6) END AS per_hour FROM c"),
}
