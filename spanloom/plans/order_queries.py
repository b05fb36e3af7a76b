"""Queries of filters, orders, samples and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import graph as gr
from spanloom.operators import intervals as iv
from spanloom.operators import order as od
from spanloom.operators import stores as st
from spanloom.plans.text_queries import DOMAIN_SQL
from spanloom.plans.common import EVENT_SQL, SPAN_SQL, events, pick, pick_sql, rounded, second_spans, table

_USER = ["user_id"]
_HOUR, _DAY = 3600, 86_400_000_000
_NOW = "2024-01-31"
_TIERS = {"error": 3, "purchase": 2, "signup": 2, "click": 1, "view": 0}
_SIGNALS = ("lexical", "catalogMatch", "slot", "none")


def _now():
    return F.lit(_NOW).cast("timestamp").cast("long") * 1_000_000


def inventory(spark, sf_dir):
    """Spans on a clock of a day, by the reason that rejects them; a content chapter is the fourth hour."""
    start, end = F.pmod(F.col("start"), F.lit(86_400)), F.pmod(F.col("start"), F.lit(86_400)) + F.col("end") - F.col("start")
    chapter = (start < 4 * _HOUR) & (end > 3 * _HOUR)
    return second_spans(spark, sf_dir).groupBy(od.inventory_reason(start, end, F.lit(86_400.0), chapter, floor=60.0, margin=900.0).alias("reason")).agg(F.count("*").alias("n"))


def precision_gate(spark, sf_dir):
    signals = F.filter(F.array(pick(F.col("k"), _SIGNALS), pick(F.floor(F.col("k") / 4), _SIGNALS)), lambda s: s != "none")
    return second_spans(spark, sf_dir).groupBy(od.precision_class(F.lit(10.0), 10.0 + F.col("v"), F.col("u"), F.lit(300.0), signals, ui=0.2, auto=0.35).alias("class")).agg(F.count("*").alias("n"))


def evidence_ordinals(spark, sf_dir):
    """Ordinals as JSON, of training evidence only: their least and largest."""
    listed = F.to_json(F.array("k", F.floor("v"), F.col("k") + 5))
    rows = events(spark, sf_dir).where("kind <> 'error'").select("event_id", F.from_json(listed, "array<int>").alias("o"))
    return rows.select("event_id", F.array_min("o").cast("long").alias("first"), F.array_max("o").cast("long").alias("last"))


def admission(spark, sf_dir):
    k = F.col("k")
    reason = od.first_reason({"thermal": k % 11 == 0, "transport": (F.col("kind") == "view") & (k % 3 == 0), "storage": F.col("v") > 150})
    return events(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("admitted")).alias("decision")).agg(F.count("*").alias("n"))


def reliability(spark, sf_dir):
    """Which gates a text passes by its share of letters."""
    share = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.length("text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", share.alias("share"))
    return rows.select("item_id", (F.col("share") >= 0.5).alias("lexical"), (F.col("share") >= 0.7).alias("fingerprint"), (F.col("share") >= 0.8).alias("model"))


def predicate_fetch(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F") & F.col("o_orderdate").isNotNull() & (F.col("o_totalprice") > 100_000)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def redacted_columns(spark, sf_dir):
    """An allow-list of columns; names and balances never leave."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


def sanitized_ids(spark, sf_dir):
    """Corrections with synthetic ids; those of no known asset are dropped and counted."""
    assets = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.substring(F.sha2(F.concat(F.lit("asset-"), F.col("c_custkey").cast("string")), 256), 1, 8).alias("asset"))
    rows = events(spark, sf_dir).where("kind = 'error'").join(assets, "user_id", "left")
    return rows.groupBy(F.coalesce("asset", F.lit("dropped")).alias("asset")).agg(F.count("*").alias("n"))


def diagnostics(spark, sf_dir):
    clean = tx.redact(F.col("text"), (("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>"), ("(/[A-Za-z0-9._-]+){3,}", "<path>"), ("[0-9a-f]{8,}", "<hex>")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring(tx.collapse(clean), 1, 512)).alias("line_md5"))


def cause_ladder(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("at") / _DAY))
    return od.primary_cause(rows, ["user_id", "day"], "kind", _TIERS)


def scarcity(spark, sf_dir):
    """The twelve most urgent jobs: by tier, then price, then age, and their new priorities."""
    tier = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(3)
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", tier.alias("tier"), "o_totalprice", "o_orderdate")
    return od.reprioritized(jobs, [F.asc("tier"), F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")], 12).select("o_orderkey", "priority")


def scan_order(spark, sf_dir):
    """Views by the weight of the purchases whose half-hour neighbourhood they touch; a user's ten best."""
    seeds = second_spans(spark, sf_dir, "purchase").select("user_id", (F.col("start") - 1800).alias("start"), (F.col("end") + 1800).alias("end"), "k")
    touched = iv.overlap_join(second_spans(spark, sf_dir, "view"), seeds, _USER, bucket=6 * _HOUR).groupBy("user_id", F.col("a.event_id").alias("event_id"), F.col("a.start").alias("start")).agg(F.sum("b.k").alias("score"))
    place = F.row_number().over(st.Window.partitionBy("user_id").orderBy(F.desc("score"), "start", "event_id"))
    return touched.where("score > 0").withColumn("place", place).where("place <= 10").select("user_id", "event_id", "score", "place")


def candidate_windows(spark, sf_dir):
    """Sponsored windows (purchases) before the nearest ones: a priority by user."""
    rows = second_spans(spark, sf_dir).where("kind IN ('purchase', 'click')").withColumn("tier", F.when(F.col("kind") == "purchase", 0).otherwise(1))
    place = F.row_number().over(st.Window.partitionBy("user_id").orderBy("tier", "start", "event_id"))
    return rows.select("user_id", "event_id", place.alias("place")).where("place <= 5")


def best_likelihood(spark, sf_dir):
    """The largest score of the clicks that a purchase overlaps, and the best event after the fifteenth day."""
    spans = iv.overlap_join(second_spans(spark, sf_dir, "purchase"), second_spans(spark, sf_dir, "click"), _USER, bucket=6 * _HOUR)
    return spans.groupBy(F.col("a.event_id").alias("event_id")).agg(F.max("b.k").alias("best"))


def likelihood_beyond(spark, sf_dir):
    beyond = second_spans(spark, sf_dir).where(F.col("end") > F.lit("2024-01-16").cast("timestamp").cast("long")).where("k >= 50")
    return beyond.groupBy("user_id").agg(F.min(F.struct((-F.col("k")).alias("a"), "start", "event_id"))["event_id"].alias("event_id"))


def coverage_plan(spark, sf_dir):
    each = events(spark, sf_dir).groupBy("user_id").agg(F.countDistinct(F.floor(F.col("at") / _DAY)).alias("observed"), F.avg((F.col("kind") != "error").cast("double")).alias("recall"), F.max("k").alias("k"))
    return each.groupBy(od.coverage_plan(F.col("observed"), F.col("recall"), F.col("k") - 85, stable=0.8).alias("plan")).agg(F.count("*").alias("n"))


def first_mid_last(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("end"))
    return od.first_mid_last(turns, ["conv_id"], 10.0, 10.0, 10.0).select("conv_id", "turn")


def min_by(spark, sf_dir):
    """Each kind's first purchase price band's earliest event: the canonical id is the earliest one."""
    return events(spark, sf_dir).groupBy("kind", F.floor(F.col("v") / 50).alias("band")).agg(F.min(F.struct("at", "event_id"))["event_id"].alias("canonical"))


def fetch_sorted(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def stratified(spark, sf_dir):
    return od.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "fixture-", 3)


def next_job(spark, sf_dir):
    """The thirty jobs to run next: priority, then age."""
    k = F.col("k")
    jobs = events(spark, sf_dir).select("event_id", F.when(F.col("kind") == "view", "playback").otherwise("backfill").alias("lane"), F.col("u").alias("coverage"), F.lit(0.5).alias("wanted"), F.col("at").alias("eligible_at"), k.alias("priority"), "at")
    return od.next_jobs(jobs, F.lit("2024-01-20").cast("timestamp").cast("long") * 1_000_000, True).orderBy(F.desc("priority"), "at", "event_id").limit(30).select("event_id", "lane", "priority")


def job_dedup(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "kind", "k", "at", "event_id")
    return od.first_arrivals(rows, ["user_id", "kind", "k"], ["at", "event_id"]).select("user_id", "kind", "k", "event_id")


def correction_dedup(spark, sf_dir):
    """Corrections on a grid of tenths: how often each was sent."""
    rows = events(spark, sf_dir).select("user_id", "kind", F.round("v", 1).alias("t"), "at")
    return rows.groupBy("user_id", "kind", "t").agg(F.count("*").alias("n"), F.max("at").alias("latest"))


def merged_corrections(spark, sf_dir):
    """Distinct corrections, and those that touch or lie within ten minutes as one."""
    rows = second_spans(spark, sf_dir, "error").select("user_id", "start", "end").distinct()
    return iv.merge(rows.withColumn("n", F.lit(1).cast("long")), _USER, gap=600, sums=["n"])


def dedup_anchors(spark, sf_dir):
    """The first row of each identity, in order."""
    rows = second_spans(spark, sf_dir).select("user_id", "kind", F.floor(F.col("k") / 20).alias("slot"), "ord", "event_id")
    return od.first_arrivals(rows, ["user_id", "kind", "slot"], ["ord"]).select("user_id", "kind", "slot", "event_id")


def reject_prune(spark, sf_dir):
    """Word pairs and triples of benchmark passages without those that a longer one explains."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +"), lambda w: w != "")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.inline(F.array(F.struct(words.alias("w"))))).where(F.size("w") >= 3)
    grams = F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    counted = rows.select("item_id", F.explode(F.array_distinct(grams)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("support")).where("support >= 2")
    return od.unsubsumed(counted, "phrase", "phrase", "support")


def interval_union_add(spark, sf_dir):
    """Clicks added to the merged time of purchases."""
    base = iv.merge(second_spans(spark, sf_dir, "purchase"), _USER)
    return iv.merge(base.unionByName(second_spans(spark, sf_dir, "click").select("user_id", "start", "end")), _USER)


def canonicalize(spark, sf_dir):
    """Draft spans (views, clicks) that final ones (purchases) cover whole go; those that they meet in part stay and are counted."""
    final, draft = second_spans(spark, sf_dir, "purchase"), second_spans(spark, sf_dir, "view", "click")
    pairs = iv.overlap_join(draft, iv.merge(final, _USER), _USER, bucket=6 * _HOUR)
    covered = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    met = pairs.groupBy(F.col("a.event_id").alias("event_id")).agg(F.max(covered.cast("int")).alias("whole"))
    kept = draft.join(met, "event_id", "left").where("whole IS NULL OR whole = 0").withColumn("partly", F.col("whole").isNotNull())
    return kept.groupBy("user_id").agg(F.count("*").alias("retained"), F.sum(F.col("partly").cast("long")).alias("overlapping"))


def upsert(spark, sf_dir):
    """A store of the first twenty days, and what the last ten bring."""
    part = lambda c: events(spark, sf_dir).where(c).groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.max("k").alias("confidence"), F.max("at").alias("last_seen"))
    cut = F.lit("2024-01-21").cast("timestamp").cast("long") * 1_000_000
    return st.upsert(part(F.col("at") < cut), part(F.col("at") >= cut), ["user_id", "kind"])


def lifecycle(spark, sf_dir):
    rows = events(spark, sf_dir).where("kind IN ('purchase', 'error')")
    return st.lifecycle(rows, ["user_id"], ["at", "event_id"], F.col("kind") == "purchase", F.col("kind") == "error")


def listening(spark, sf_dir):
    return st.listening_time(second_spans(spark, sf_dir), _USER, "start", F.col("kind").isin("view", "click"), longest=4 * _HOUR)


def average(spark, sf_dir):
    return st.moving_average(events(spark, sf_dir), _USER, [F.desc("at"), F.desc("event_id")], "v").select("user_id", F.round("average", 6).alias("average"), "n")


def prior_hierarchy(spark, sf_dir):
    """A default, a network, a trait and a local value blended one after the other by how much is known of each."""
    each = events(spark, sf_dir).groupBy("user_id").agg(F.countDistinct(F.floor(F.col("at") / _DAY)).alias("days"), F.avg("u").alias("u"), F.avg(F.col("k") / 100).alias("k"), F.avg(F.when(F.col("kind") == "click", F.col("u"))).alias("c"))
    n = F.pmod(F.col("days"), F.lit(9))
    net = F.greatest(F.lit(0.0), 1 - n / 10) * 0.5
    first = st.network_blend(F.lit(0.5), F.col("u"), net)
    second = st.network_blend(first, F.col("k"), st.trait_weight(n))
    third = st.network_blend(second, F.coalesce("c", F.lit(0.5)), st.local_weight(n))
    return each.select("user_id", F.round(third + 1e-9, 6).alias("trust"), F.when(n >= 5, "showLocal").when(n >= 3, "trait").otherwise("network").alias("level"))


def demotion(spark, sf_dir):
    delta = F.when(F.col("kind") == "view", 0.02).otherwise(0.05)
    floor = F.when(F.col("kind") == "view", 0.5).otherwise(0.3)
    return st.demotion(events(spark, sf_dir).where("kind IN ('view', 'error')"), ["user_id", "kind"], delta, floor).select("user_id", "kind", "n", F.round("multiplier", 6).alias("multiplier"))


def lease_journal(spark, sf_dir):
    """Each user's latest run; those begun and silent for six hours are orphans."""
    runs = st.latest(events(spark, sf_dir).select("user_id", "kind", "at", "event_id"), _USER, ["at", "event_id"])
    runs = runs.withColumns({"ended": F.when(F.col("kind") == "purchase", F.col("at")), "beat": F.col("at")})
    return st.orphans(runs, _now(), _DAY // 4).select("user_id", "event_id")


def repeated_cache(spark, sf_dir):
    """Entries by user and score: purged by age, revoked by an error, the rest with count and last touch."""
    fresh = events(spark, sf_dir).where(F.col("at") >= _now() - 14 * _DAY)
    entries = fresh.where("kind <> 'error'").groupBy("user_id", "k").agg(F.count("*").alias("n"), F.max("at").alias("last_seen"))
    return entries.join(fresh.where("kind = 'error'").select("user_id", "k").distinct(), ["user_id", "k"], "left_anti")


def broad_correction(spark, sf_dir):
    rows = events(spark, sf_dir).where("kind IN ('error', 'click')").select("k", F.when(F.col("kind") == "error", 1.0).otherwise(0.3).alias("weight"), F.col("user_id").alias("episode"), F.floor(F.col("at") / _DAY).alias("day"), "at")
    return st.broad_promotion(rows, ["k"], "at", _now(), 10 * _DAY, 2, 2, 2).select("k", F.round("weighted", 6).alias("weighted"), "episodes", "days")


def attribution(spark, sf_dir):
    """A user's cause by day: the heaviest entry of the ledger, else where the day came from."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("at") / _DAY))
    heavy = F.when(F.col("kind").isin("purchase", "click"), F.struct("k", "event_id", "kind"))
    return rows.groupBy("user_id", "day").agg(F.coalesce(F.max(heavy)["kind"], F.concat(F.lit("from "), F.min("kind"))).alias("source"))


def invariants(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rules = {"late": F.col("l_discount") > 0.09, "free": F.col("l_tax") == 0, "single": F.col("l_quantity") < 2}
    return st.findings(lines, "l_orderkey", rules).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


def _links(spark, sf_dir):
    """Users who have the same kind and k on one day."""
    rows = events(spark, sf_dir).select("user_id", F.concat_ws(":", "kind", "k", F.floor(F.col("at") / _DAY).cast("string")).alias("shared")).distinct()
    hub = rows.groupBy("shared").agg(F.min("user_id").alias("b"))
    return rows.join(hub, "shared").where("user_id <> b").select(F.col("user_id").alias("a"), "b").where("a % 4 = b % 4")


def components(spark, sf_dir):
    return gr.components(_links(spark, sf_dir))


def canonical(spark, sf_dir):
    """Each user's canonical one: of its component the first, by first event, of those with a signup."""
    members = events(spark, sf_dir).groupBy("user_id").agg(F.min("at").alias("first"), F.max((F.col("kind") == "signup") & (F.col("k") > 90)).alias("sponsor"))
    return gr.canonical(members, gr.components(_links(spark, sf_dir)), "user_id", F.col("sponsor"), F.col("first"))


def ownership(spark, sf_dir):
    """Each domain's label from the source of the highest precedence."""
    rows = table(spark, sf_dir, "pages").select(tx.domain(F.col("url")).alias("domain"), (F.col("page_id") % 3).cast("int").alias("source"), F.when(F.col("page_id") % 2 == 0, "show").otherwise("sponsor").alias("label"))
    return rows.where("domain IS NOT NULL").groupBy("domain").agg(F.max(F.struct("source", "label"))["label"].alias("label"))


def fusion_ledger(spark, sf_dir):
    """Ledgers of a user's day: model entries join in full mode only, negative verdicts never; quorum of two kinds, and the capped score."""
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("at") / _DAY))
    full = F.col("user_id") % 2 == 0
    some = rows.where((F.col("kind") != "signup") | (full & (F.col("k") >= 50)))
    weight = F.least(rounded("u", 2), F.when(F.col("kind") == "view", 0.2).otherwise(0.35)).cast("decimal(10,2)")
    each = some.groupBy("user_id", "day").agg(F.countDistinct("kind").alias("kinds"), F.least(F.lit(1).cast("decimal(10,2)"), F.sum(weight)).cast("double").alias("score"))
    return each.select("user_id", "day", F.round("score", 2).alias("score"), F.when(F.col("kinds") < 2, "blockedByQuorum").otherwise("eligible").alias("gate"))


def store_reads(spark, sf_dir):
    """The latest order of each customer, and whether it lacks lines: keyed reads with an anti-join."""
    orders = st.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 30").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders.join(lines, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


_SIG = f"list_filter([{pick_sql('k', _SIGNALS)}, {pick_sql('k // 4', _SIGNALS)}], lambda s: s NOT IN ('none', 'catalogMatch'))"
_EDGES = EVENT_SQL + ", r AS (SELECT DISTINCT user_id, kind || ':' || k || ':' || (tm // 86400000000) AS shared FROM ev), h AS (SELECT shared, min(user_id) AS b FROM r GROUP BY 1), e AS (SELECT DISTINCT user_id AS a, b FROM r JOIN h USING (shared) WHERE user_id <> b AND user_id % 4 = b % 4), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, a AS z FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON two.a = reach.z), comp AS (SELECT a AS node, min(z) AS component FROM reach GROUP BY 1)"
_ISLANDS = lambda cond, gap=0: f"i AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT user_id, s, e FROM sp WHERE {cond}))) GROUP BY user_id, g)"
_RATE = "CASE WHEN c + r > 0 THEN r / (c + r) ELSE 0 END"
_STEP = f"CASE st WHEN 'candidate' THEN CASE WHEN c >= 1 THEN 'quarantined' ELSE st END WHEN 'quarantined' THEN CASE WHEN c >= 2 AND {_RATE} <= 0.3e0 THEN 'active' ELSE st END WHEN 'active' THEN CASE WHEN {_RATE} > 0.5e0 THEN 'decayed' ELSE st END WHEN 'decayed' THEN CASE WHEN c >= 2 AND {_RATE} <= 0.3e0 THEN 'active' ELSE st END ELSE st END"
_TIER_SQL = "CASE kind " + " ".join(f"WHEN '{c}' THEN {-t * 10 + i}" for i, (c, t) in enumerate(_TIERS.items())) + " END"

QUERIES = {
    "flt_inventory_sanity": (inventory, f"WITH {SPAN_SQL}, c AS (SELECT s % 86400 AS a, s % 86400 + e - s AS z FROM sp) SELECT CASE WHEN NOT z - a >= 60 THEN 'tooShort' WHEN z <= 900 THEN 'tooEarly' WHEN a >= 86400 - 900 THEN 'tooLate' WHEN a < 14400 AND z > 10800 THEN 'contentChapter' END AS reason, count(*) AS n FROM c GROUP BY 1"),
    "flt_precision_gate": (precision_gate, f"WITH {EVENT_SQL} SELECT CASE WHEN 10 + v > 300 OR v <= 0 OR u < 0.2e0 THEN 'detectionOnly' WHEN u < 0.35e0 THEN 'uiCandidate:belowAutoSkipThreshold' WHEN NOT ((10 + v) - 10 BETWEEN 30 AND 90) THEN 'uiCandidate:durationImplausible' WHEN len({_SIG}) = 0 THEN 'uiCandidate:noSafetySignals' ELSE 'autoSkipEligible' END AS class, count(*) AS n FROM ev GROUP BY 1"),
    "flt_evidence_json": (evidence_ordinals, f"WITH {EVENT_SQL} SELECT event_id, least(k, CAST(floor(v) AS BIGINT)) AS first, greatest(k + 5, CAST(floor(v) AS BIGINT)) AS last FROM ev WHERE kind <> 'error'"),
    "flt_admission": (admission, f"WITH {EVENT_SQL} SELECT CASE WHEN k % 11 = 0 THEN 'thermal' WHEN kind = 'view' AND k % 3 = 0 THEN 'transport' WHEN v > 150 THEN 'storage' ELSE 'admitted' END AS decision, count(*) AS n FROM ev GROUP BY 1"),
    "flt_reliability": (reliability, "WITH s AS (SELECT item_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / length(text) AS share FROM benchmark) SELECT item_id, share >= 0.5e0 AS lexical, share >= 0.7e0 AS fingerprint, share >= 0.8e0 AS model FROM s"),
    "flt_predicate_fetch": (predicate_fetch, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate IS NOT NULL AND o_totalprice > 100000 GROUP BY 1"),
    "prj_redact": (redacted_columns, "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "prj_sanitize": (sanitized_ids, f"WITH {EVENT_SQL} SELECT coalesce(substring(sha256('asset-' || c_custkey), 1, 8), 'dropped') AS asset, count(*) AS n FROM ev LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = user_id WHERE kind = 'error' GROUP BY 1"),
    "flt_diag_sanitize": (diagnostics, "SELECT doc_id, md5(substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '(/[A-Za-z0-9._-]+){3,}', '<path>', 'g'), '[0-9a-f]{8,}', '<hex>', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 512)) AS line_md5 FROM documents"),
    "topk_cause_ladder": (cause_ladder, f"WITH {EVENT_SQL} SELECT user_id, tm // 86400000000 AS day, arg_min(kind, {_TIER_SQL}) AS primary, count(DISTINCT kind) - 1 AS secondary FROM ev GROUP BY 1, 2"),
    "topk_scarcity": (scarcity, "SELECT o_orderkey, greatest(1, 10 - row_number() OVER w) AS priority FROM orders WHERE o_orderstatus = 'O' WINDOW w AS (ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderdate, o_orderkey) QUALIFY row_number() OVER w <= 12"),
    "topk_scan_order": (scan_order, f"WITH {SPAN_SQL}, t AS (SELECT a.user_id, a.event_id, a.s, sum(b.k) AS score FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s < b.e + 1800 AND b.s - 1800 < a.e WHERE a.kind = 'view' AND b.kind = 'purchase' GROUP BY 1, 2, 3) SELECT user_id, event_id, CAST(score AS BIGINT) AS score, row_number() OVER w AS place FROM t WHERE score > 0 WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, s, event_id) QUALIFY row_number() OVER w <= 10"),
    "topk_candidate_windows": (candidate_windows, f"WITH {SPAN_SQL} SELECT user_id, event_id, row_number() OVER w AS place FROM sp WHERE kind IN ('purchase', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY CASE WHEN kind = 'purchase' THEN 0 ELSE 1 END, s, event_id) QUALIFY row_number() OVER w <= 5"),
    "topk_likelihood": (best_likelihood, f"WITH {SPAN_SQL} SELECT a.event_id, max(b.k) AS best FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.kind = 'purchase' AND b.kind = 'click' GROUP BY 1"),
    "topk_likelihood_beyond": (likelihood_beyond, f"WITH {SPAN_SQL} SELECT user_id, event_id FROM sp WHERE e > epoch_us(TIMESTAMP '2024-01-16') // 1000000 AND k >= 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, s, event_id) = 1"),
    "topk_coverage_plan": (coverage_plan, f"WITH {EVENT_SQL}, g AS (SELECT user_id, count(DISTINCT tm // 86400000000) AS observed, avg(CASE WHEN kind <> 'error' THEN 1e0 ELSE 0e0 END) AS recall, max(k) AS k FROM ev GROUP BY 1) SELECT CASE WHEN observed < 5 OR recall < 0.8e0 THEN 'full' WHEN k - 85 >= 10 THEN 'periodicFull' ELSE 'targeted' END AS plan, count(*) AS n FROM g GROUP BY 1"),
    "topk_first_mid_last": (first_mid_last, "WITH c AS (SELECT conv_id, turn, turn * 10 AS a, turn * 10 + 10 AS z, min(turn * 10) OVER (PARTITION BY conv_id) AS lo, max(turn * 10 + 10) OVER (PARTITION BY conv_id) AS hi FROM conversations) SELECT conv_id, turn FROM c WHERE a < lo + 10 OR z > hi - 10 OR (hi - lo > 30 AND z > (lo + hi) / 2 - 5 AND a < (lo + hi) / 2 + 5)"),
    "topk_min_by": (min_by, f"WITH {EVENT_SQL} SELECT kind, CAST(floor(v / 50) AS BIGINT) AS band, event_id AS canonical FROM ev QUALIFY row_number() OVER (PARTITION BY kind, floor(v / 50) ORDER BY tm, event_id) = 1"),
    "topk_fetch_sorted": (fetch_sorted, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "topk_stratified_fixture": (stratified, "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256('fixture-' || doc_id), doc_id) <= 3"),
    "abs_next_job": (next_job, f"WITH {EVENT_SQL} SELECT event_id, CASE WHEN kind = 'view' THEN 'playback' ELSE 'backfill' END AS lane, k AS priority FROM ev WHERE (kind <> 'view' OR u < 0.5e0) AND tm <= epoch_us(TIMESTAMP '2024-01-20') ORDER BY k DESC, tm, event_id LIMIT 30"),
    "abs_job_dedup": (job_dedup, f"WITH {EVENT_SQL} SELECT user_id, kind, k, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, kind, k ORDER BY tm, event_id) = 1"),
    "abs_correction_dedup": (correction_dedup, f"WITH {EVENT_SQL} SELECT user_id, kind, round(v, 1) AS t, count(*) AS n, max(tm) AS latest FROM ev GROUP BY 1, 2, 3"),
    "set_dedup_corrections": (merged_corrections, f"WITH {SPAN_SQL}, {_ISLANDS('kind = ' + repr('error'), 600)} SELECT user_id, s AS \"start\", e AS \"end\", n FROM i"),
    "set_dedup_anchor": (dedup_anchors, f"WITH {SPAN_SQL} SELECT user_id, kind, k // 20 AS slot, event_id FROM sp QUALIFY row_number() OVER (PARTITION BY user_id, kind, k // 20 ORDER BY ord) = 1"),
    "set_reject_prune": (reject_prune, "WITH b AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +'), lambda w: w <> '') AS w FROM benchmark), g AS (SELECT item_id, unnest(list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS phrase FROM b WHERE len(w) >= 3), c AS (SELECT phrase, count(*) AS support FROM g GROUP BY 1 HAVING count(*) >= 2) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c l WHERE length(l.phrase) > length(c.phrase) AND contains(' ' || l.phrase || ' ', ' ' || c.phrase || ' ') AND 2 * l.support >= c.support)"),
    "set_interval_union_add": (interval_union_add, f"WITH {SPAN_SQL}, {_ISLANDS('kind IN (' + repr('purchase') + ', ' + repr('click') + ')')} SELECT user_id, s AS \"start\", e AS \"end\" FROM i"),
    "win_canonicalize": (canonicalize, f"WITH {SPAN_SQL}, {_ISLANDS('kind = ' + repr('purchase'))}, d AS (SELECT a.user_id, a.event_id, max(CASE WHEN i.s <= a.s AND a.e <= i.e THEN 1 ELSE 0 END) AS whole, count(i.s) AS met FROM sp a LEFT JOIN i ON i.user_id = a.user_id AND a.s < i.e AND i.s < a.e WHERE kind IN ('view', 'click') GROUP BY 1, 2) SELECT user_id, count(*) AS retained, count(*) FILTER (WHERE met > 0) AS overlapping FROM d WHERE whole = 0 GROUP BY 1"),
    "kv_upsert": (upsert, f"WITH {EVENT_SQL} SELECT user_id, kind, count(*) AS n, max(k) AS confidence, max(tm) AS last_seen FROM ev GROUP BY 1, 2"),
    "st_trust_lifecycle": (lifecycle, None),
    "st_listening_time": (listening, f"WITH {SPAN_SQL}, g AS (SELECT user_id, kind, least(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) - s, 14400) AS g FROM sp) SELECT user_id, CAST(coalesce(sum(g) FILTER (WHERE kind IN ('view', 'click') AND g > 0), 0) AS BIGINT) AS listened FROM g GROUP BY 1"),
    "st_ema": (average, f"WITH RECURSIVE {SPAN_SQL}, a AS (SELECT user_id, ord, v AS x FROM sp WHERE ord = 1 UNION ALL SELECT sp.user_id, sp.ord, 0.3e0 * sp.v + 0.7e0 * a.x FROM a JOIN sp ON sp.user_id = a.user_id AND sp.ord = a.ord + 1) SELECT user_id, round(arg_max(x, ord), 6) AS average, max(ord) AS n FROM a GROUP BY 1"),
    "st_prior_hierarchy": (prior_hierarchy, f"WITH {EVENT_SQL}, g AS (SELECT user_id, count(DISTINCT tm // 86400000000) % 9 AS n, avg(u) AS u, avg(k / 100) AS k, avg(u) FILTER (WHERE kind = 'click') AS c FROM ev GROUP BY 1), w AS (SELECT *, greatest(0, 1 - n / 10) * 0.5e0 AS wn, CASE WHEN n >= 3 THEN 0.4e0 + 0.2e0 * (least(n, 7) - 3) / 4 ELSE 0 END AS wt, CASE WHEN n >= 5 THEN 0.6e0 + 0.2e0 * (least(n, 10) - 5) / 5 ELSE 0 END AS wl FROM g), f AS (SELECT *, 0.5e0 * (1 - wn) + u * wn AS a FROM w), s AS (SELECT *, a * (1 - wt) + k * wt AS b FROM f) SELECT user_id, round(b * (1 - wl) + coalesce(c, 0.5e0) * wl + 1e-9, 6) AS trust, CASE WHEN n >= 5 THEN 'showLocal' WHEN n >= 3 THEN 'trait' ELSE 'network' END AS level FROM s"),
    "st_demotion": (demotion, "SELECT user_id, event_type AS kind, count(*) AS n, round(CASE WHEN event_type = 'view' THEN greatest(0.5e0, 1 - count(*) * 0.02e0) ELSE greatest(0.3e0, 1 - count(*) * 0.05e0) END, 6) AS multiplier FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2"),
    "st_lease_journal": (lease_journal, f"WITH {EVENT_SQL}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, event_id DESC) = 1) SELECT user_id, event_id FROM l WHERE kind <> 'purchase' AND epoch_us(TIMESTAMP '2024-01-31') - tm > 21600000000"),
    "kv_repeated_cache": (repeated_cache, f"WITH {EVENT_SQL}, f AS (SELECT * FROM ev WHERE tm >= epoch_us(TIMESTAMP '2024-01-17')) SELECT user_id, k, count(*) AS n, max(tm) AS last_seen FROM f a WHERE kind <> 'error' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.user_id = a.user_id AND b.k = a.k AND b.kind = 'error') GROUP BY 1, 2"),
    "kv_broad_correction": (broad_correction, f"WITH {EVENT_SQL}, g AS (SELECT k, sum(CASE WHEN kind = 'error' THEN 1e0 ELSE 0.3e0 END) AS weighted, count(DISTINCT user_id) AS episodes, count(DISTINCT tm // 86400000000) AS days FROM ev WHERE kind IN ('error', 'click') AND tm >= epoch_us(TIMESTAMP '2024-01-21') GROUP BY 1) SELECT k, round(weighted, 6) AS weighted, episodes, days FROM g WHERE weighted >= 2 - 1e-9 AND episodes >= 2 AND days >= 2"),
    "kv_attribution": (attribution, f"WITH {EVENT_SQL} SELECT user_id, tm // 86400000000 AS day, coalesce(arg_max(kind, k * 100000000 + event_id) FILTER (WHERE kind IN ('purchase', 'click')), 'from ' || min(kind)) AS source FROM ev GROUP BY 1, 2"),
    "kv_invariants": (invariants, "SELECT rule, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN l_discount > 0.09e0 THEN 'late' END, CASE WHEN l_tax = 0 THEN 'free' END, CASE WHEN l_quantity < 2 THEN 'single' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) GROUP BY 1"),
    "gr_components": (components, f"WITH RECURSIVE {_EDGES} SELECT node, component FROM comp"),
    "gr_canonical_lookup": (canonical, f"WITH RECURSIVE {_EDGES}, m AS (SELECT user_id, min(tm) AS first, bool_or(kind = 'signup' AND k > 90) AS sponsor FROM ev GROUP BY 1), n AS (SELECT m.*, coalesce(component, user_id) AS c FROM m LEFT JOIN comp ON node = user_id) SELECT user_id, first_value(user_id) OVER (PARTITION BY c ORDER BY CASE WHEN sponsor THEN 0 ELSE 1 END, first, user_id) AS canonical FROM n"),
    "gr_ownership": (ownership, "SELECT d AS domain, arg_max(CASE WHEN page_id % 2 = 0 THEN 'show' ELSE 'sponsor' END, (page_id % 3) * 10 + CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END) AS label FROM (" + DOMAIN_SQL.format(source="(SELECT page_id, url AS u FROM pages)") + ") WHERE d IS NOT NULL GROUP BY 1"),
    "abs_fusion_ledger": (fusion_ledger, f"WITH {EVENT_SQL} SELECT user_id, tm // 86400000000 AS day, round(least(1, CAST(sum(CAST(least(round(u, 2), CASE WHEN kind = 'view' THEN 0.2e0 ELSE 0.35e0 END) AS DECIMAL(10,2))) AS DOUBLE)), 2) AS score, CASE WHEN count(DISTINCT kind) < 2 THEN 'blockedByQuorum' ELSE 'eligible' END AS gate FROM ev WHERE kind <> 'signup' OR (user_id % 2 = 0 AND k >= 50) GROUP BY 1, 2"),
    "abs_store_reads": (store_reads, "WITH l AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT * FROM l WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 30)"),
}
