"""Queries of the column functions on numbers, times and JSON, over ``events`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import scores as sc
from spanloom.functions import text as tx
from spanloom.plans.common import EVENT_SQL, events, pick, pick_sql, table

_KNOTS = ((0.0, 0.0), (0.3, 0.1), (0.7, 0.8), (1.0, 1.0))
_CAPS = {"view": 0.2, "click": 0.35, "purchase": 0.5}
_KINDS = ("view", "click", "purchase", "signup", "error")
_INTENTS, _OWNERS = ("paid", "owned", "affiliate", "organic", "unknown"), ("thirdParty", "show", "network", "guest", "unknown")
_CLASSES = tuple(sc.ELIGIBILITY)


def calibrated(spark, sf_dir):
    u = F.col("u")
    return events(spark, sf_dir).select("event_id", F.round(sc.platt(u, -4.0, 2.0), 6).alias("platt"), F.round(sc.monotone(u, _KNOTS), 6).alias("monotone"))


def duration_prior(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(sc.duration_prior(F.col("v")), 6).alias("multiplier"))


def duration_bucket(spark, sf_dir):
    return events(spark, sf_dir).groupBy(sc.duration_bucket(F.col("v") * 30).alias("bucket")).agg(F.count("*").alias("n"))


def condition(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"network": pick(F.col("k"), ("wifi", "cellular", "none")), "thermal": pick(F.floor(F.col("k") / 3), ("nominal", "fair", "serious", "critical"))})
    level = F.when(F.col("k") % 7 == 0, -1.0).otherwise(F.col("u"))
    return e.groupBy(sc.execution_condition(F.col("network"), level, F.col("kind") == "click", F.col("thermal"), F.col("k") > 95).alias("condition")).agg(F.count("*").alias("n"))


def rule_score(spark, sf_dir):
    k = F.col("k") / 100
    return events(spark, sf_dir).select("event_id", F.round(sc.rule_score(F.col("u"), k, 1 - k, F.col("u") * k, F.lit(0.7), F.lit(0.5)), 6).alias("score"))


def decayed(spark, sf_dir):
    age = F.col("v") / 2
    return events(spark, sf_dir).select("event_id", F.round(sc.decay(age, 120.0, 0.2), 6).alias("memory"), F.round(sc.decay(age, 90.0, 0.1), 6).alias("prior"))


def beta(spark, sf_dir):
    """Each user's posterior from Beta(2, 2): purchases succeed, errors fail."""
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).cast("double")
    each = events(spark, sf_dir).groupBy("user_id").agg((2 + count("purchase")).alias("a"), (2 + count("error")).alias("b"))
    return each.select("user_id", F.round(sc.beta_mean(F.col("a"), F.col("b")), 6).alias("mean"), F.round(sc.beta_variance(F.col("a"), F.col("b")), 9).alias("variance"))


def composite(spark, sf_dir):
    there = lambda kind, x: F.when(F.col("kind") != kind, x)
    blend = sc.composite(there("view", F.col("u")), there("click", F.col("k") / 100), there("error", 1 - F.col("u")), F.col("k") / 80)
    return events(spark, sf_dir).select("event_id", F.round(blend + 1e-9, 6).alias("score"))


def gap_confidence(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(sc.gap_confidence(F.col("v"), F.col("k") * 2), 6).alias("confidence"), sc.least_gap(F.col("k"), F.lit(2.0)).alias("least_gap"))


def policy(spark, sf_dir):
    e = events(spark, sf_dir).select(pick(F.col("k"), _INTENTS).alias("intent"), pick(F.floor(F.col("k") / 5), _OWNERS).alias("ownership"))
    return e.groupBy("intent", "ownership", sc.policy_action(F.col("intent"), F.col("ownership")).alias("action")).agg(F.count("*").alias("n"))


def eligible(spark, sf_dir):
    e = events(spark, sf_dir).select(pick(F.col("k"), _CLASSES).alias("content"), (F.col("u") >= 0.5).alias("strong"))
    return e.groupBy("content", "strong", sc.eligibility(F.col("content"), F.col("strong")).alias("eligibility")).agg(F.count("*").alias("n"))


def quorum(spark, sf_dir):
    """By user and whole value: one strong signal, or weak ones of two families."""
    strong, family = F.col("kind") == "purchase", F.when(F.col("kind").isin("view", "click"), "seen").otherwise(F.col("kind"))
    each = events(spark, sf_dir).groupBy("user_id", F.floor("v").alias("slot")).agg(F.max(strong).alias("strong"), F.countDistinct(F.when(~strong, family)).alias("families"))
    return each.groupBy((F.col("strong") | (F.col("families") >= 2)).alias("met"), F.when(F.col("strong"), "strong").when(F.col("families") >= 2, "weak").alias("authority")).agg(F.count("*").alias("n"))


def clamp_ledger(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("w", sc.capped(F.col("kind"), F.col("u"), _CAPS))
    return e.groupBy("kind").agg(F.round(F.sum("w"), 4).alias("total"), F.sum((F.col("w") < F.col("u")).cast("long")).alias("cut"))


def example_buckets(spark, sf_dir):
    quality = pick(F.col("k"), ("good", "degraded", "unusable"))
    bit = lambda n: F.col("k").bitwiseAND(n) > 0
    bucket = sc.example_bucket(quality, bit(1), F.col("u"), bit(2), bit(4), 1 - F.col("u"), F.col("kind") == "error", F.col("kind") == "signup", F.col("kind") == "purchase")
    return events(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def flip_value(spark, sf_dir):
    """The twenty looks that pay most; ties to the smaller id."""
    e = events(spark, sf_dir).select("event_id", F.round(sc.flip_value(F.col("u"), F.lit(1.0), 1.0 + F.col("k")), 9).alias("evi"))
    return e.orderBy(F.desc("evi"), "event_id").limit(20)


def certainty(spark, sf_dir):
    text = F.when(F.col("k") % 4 == 0, F.lit('{"certainty":"strong"}')).when(F.col("k") % 4 == 1, F.lit('{"certainty":"odd"}')).when(F.col("k") % 4 == 2, F.concat(F.lit('{"certainty":'), F.col("k").cast("string"), F.lit("}"))).otherwise(F.lit('{"certainty":true}'))
    return events(spark, sf_dir).groupBy("k").agg(F.max(sc.certainty(text)).alias("certainty"), F.count("*").alias("n"))


def cohort_identity(spark, sf_dir):
    """Canonical JSON of a cohort's fields, keys sorted."""
    cohort = F.to_json(F.struct(F.lit("1").alias("appBuild"), F.col("kind").alias("promptLabel"), F.concat(F.lit("h"), (F.col("k") % 3).cast("string")).alias("schemaHash")))
    return events(spark, sf_dir).groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"))


def scopes(spark, sf_dir):
    name = F.when(F.col("kind") == "error", F.lit("wholeAsset:")).otherwise(F.lit("exactTimeSpan:"))
    scope = F.concat(name, F.col("user_id").cast("string"), F.lit(":"), F.col("k").cast("string"), F.lit(":"), F.floor("v").cast("string"))
    return events(spark, sf_dir).withColumn("s", sc.scope_span(scope)).where("s IS NOT NULL").groupBy("s.id").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("covered"))


def version_hashes(spark, sf_dir):
    """A conversation's version by its turns' texts in order; a conversation is one row."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return turns.select("conv_id", sc.version_hash(F.transform("t", lambda x: x["text"])).alias("version"))


def bits(spark, sf_dir):
    """Vectors as 64 bits: components above the vector's median."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "label", F.inline(F.array(F.struct(doubles.alias("v"), F.array_sort(doubles).alias("s")))))
    middle = F.inline(F.array(F.struct(((F.get("s", F.lit(31)) + F.get("s", F.lit(32))) / 2).alias("m"))))
    return rows.select("vec_id", "label", "v", middle).select("vec_id", "label", sc.pack_bits(F.transform("v", lambda x: x > F.col("m"))).alias("bits"))


def hamming(spark, sf_dir):
    """Bits in which each vector differs from the next one."""
    packed = bits(spark, sf_dir)
    after = packed.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    return packed.join(after, "vec_id").select("vec_id", "bits", sc.hamming(F.col("bits"), F.col("other")).cast("long").alias("distance"))


def canberra(spark, sf_dir):
    """Similarity of each vector to the next one, on absolute values."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select("vec_id", F.round(tx.canberra_similarity(F.col("v"), F.col("w")), 6).alias("similarity"))


_D = "e0"  # marks a number as DOUBLE
_CAP_SQL = "CASE " + " ".join(f"WHEN kind = '{k}' THEN least(u, {c}{_D})" for k, c in _CAPS.items()) + " ELSE u END"
_MONO = "CASE WHEN u <= 0 THEN 0e0 WHEN u <= 0.3e0 THEN u / 0.3e0 * 0.1e0 WHEN u <= 0.7e0 THEN 0.1e0 + (u - 0.3e0) / (0.7e0 - 0.3e0) * (0.8e0 - 0.1e0) WHEN u <= 1 THEN 0.8e0 + (u - 0.7e0) / (1e0 - 0.7e0) * (1e0 - 0.8e0) ELSE 1e0 END"
_POLICY_SQL = "CASE " + " ".join(f"WHEN intent = '{i}'" + ("" if o == "*" else f" AND ownership = '{o}'") + f" THEN '{a}'" for (i, o), a in sc.POLICY.items()) + " ELSE 'logOnly' END"
_ELIGIBLE_SQL = "CASE content " + " ".join(f"WHEN '{c}' THEN CASE WHEN strong THEN '{s}' ELSE '{w}' END" for c, (s, w) in sc.ELIGIBILITY.items()) + " END"
BITS_SQL = "bits AS (SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i]::DOUBLE > list_median(embedding::DOUBLE[]) THEN CAST(1 AS HUGEINT) << CAST(64 - i AS INTEGER) ELSE 0::HUGEINT END)) AS b FROM embeddings WHERE len(embedding) = 64)"

QUERIES = {
    "num_platt_monotone": (calibrated, f"WITH {EVENT_SQL} SELECT event_id, round(1 / (1 + exp(-4 * greatest(0, least(1, u)) + 2)), 6) AS platt, round({_MONO}, 6) AS monotone FROM ev"),
    "num_duration_prior": (duration_prior, f"WITH {EVENT_SQL} SELECT event_id, round(CASE WHEN v < 5 THEN 0.75e0 WHEN v < 30 THEN 0.9e0 + (v - 5) / 25e0 * (1.1e0 - 0.9e0) WHEN v <= 90 THEN 1.1e0 WHEN v <= 180 THEN 1.1e0 + (v - 90) / 90e0 * (0.95e0 - 1.1e0) WHEN v <= 270 THEN 0.95e0 + (v - 180) / 90e0 * (0.75e0 - 0.95e0) ELSE 0.75e0 END, 6) AS multiplier FROM ev"),
    "num_duration_bucket": (duration_bucket, "SELECT CASE WHEN value * 30 < 1800 THEN 'under30m' WHEN value * 30 <= 3600 THEN 'to60m' WHEN value * 30 <= 5400 THEN 'to90m' ELSE 'over90m' END AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "num_condition": (condition, f"WITH {EVENT_SQL}, c AS (SELECT *, {pick_sql('k', ('wifi', 'cellular', 'none'))} AS network, {pick_sql('k // 3', ('nominal', 'fair', 'serious', 'critical'))} AS thermal, CASE WHEN k % 7 = 0 THEN -1 ELSE u END AS level FROM ev) SELECT CASE WHEN network = 'cellular' OR (level >= 0 AND level < 0.2e0 AND kind <> 'click') OR thermal IN ('serious', 'critical') OR k > 95 THEN 'constrained' WHEN network = 'wifi' AND (kind = 'click' OR level >= 0.5e0) THEN 'favorable' ELSE 'mixed' END AS condition, count(*) AS n FROM c GROUP BY 1"),
    "num_rule_classifier": (rule_score, f"WITH {EVENT_SQL} SELECT event_id, round(1 / (1 + exp(-8 * (0.4e0 * u + 0.2e0 * (k / 100) + 0.15e0 * (1 - k / 100) + 0.1e0 * (u * (k / 100)) + 0.05e0 * 0.7e0 + 0.1e0 * 0.5e0 - 0.25e0))), 6) AS score FROM ev"),
    "num_decay_linear": (decayed, f"WITH {EVENT_SQL} SELECT event_id, round(greatest(0.2e0, 1 - v / 2 / 120 * 0.8e0), 6) AS memory, round(greatest(0.1e0, 1 - v / 2 / 90 * 0.9e0), 6) AS prior FROM ev"),
    "num_beta": (beta, f"WITH {EVENT_SQL}, c AS (SELECT user_id, 2e0 + count(*) FILTER (WHERE kind = 'purchase') AS a, 2e0 + count(*) FILTER (WHERE kind = 'error') AS b FROM ev GROUP BY 1) SELECT user_id, round(a / (a + b), 6) AS mean, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) AS variance FROM c"),
    "num_composite": (composite, f"WITH {EVENT_SQL}, w AS (SELECT *, greatest(0e0, least(1e0, k / 80)) AS r FROM ev), x AS (SELECT *, CASE WHEN kind <> 'view' AND r >= 0.3e0 THEN 0.5e0 * r ELSE 0 END AS wt, CASE WHEN kind <> 'click' THEN 0.3e0 ELSE 0 END AS wa, CASE WHEN kind <> 'error' THEN 0.2e0 ELSE 0 END AS wm FROM w) SELECT event_id, round((wt * u + wa * k / 100 + wm * (1 - u)) / (wt + wa + wm) + 1e-9, 6) AS score FROM x"),
    "num_confidence_gap": (gap_confidence, f"WITH {EVENT_SQL} SELECT event_id, round(1 - exp(-least(v, k * 2) / 60), 6) AS confidence, greatest(1, CAST(round_even(k / 2e0, 0) AS BIGINT)) AS least_gap FROM ev"),
    "num_policy_matrix": (policy, f"WITH {EVENT_SQL}, c AS (SELECT {pick_sql('k', _INTENTS)} AS intent, {pick_sql('k // 5', _OWNERS)} AS ownership FROM ev) SELECT intent, ownership, {_POLICY_SQL} AS action, count(*) AS n FROM c GROUP BY ALL"),
    "num_eligibility": (eligible, f"WITH {EVENT_SQL}, c AS (SELECT {pick_sql('k', _CLASSES)} AS content, u >= 0.5e0 AS strong FROM ev) SELECT content, strong, {_ELIGIBLE_SQL} AS eligibility, count(*) AS n FROM c GROUP BY ALL"),
    "num_quorum": (quorum, f"WITH {EVENT_SQL}, g AS (SELECT user_id, floor(v) AS slot, bool_or(kind = 'purchase') AS strong, count(DISTINCT CASE WHEN kind = 'purchase' THEN NULL WHEN kind IN ('view', 'click') THEN 'seen' ELSE kind END) AS families FROM ev GROUP BY 1, 2) SELECT strong OR families >= 2 AS met, CASE WHEN strong THEN 'strong' WHEN families >= 2 THEN 'weak' END AS authority, count(*) AS n FROM g GROUP BY 1, 2"),
    "num_clamp_ledger": (clamp_ledger, f"WITH {EVENT_SQL}, c AS (SELECT *, {_CAP_SQL} AS w FROM ev) SELECT kind, round(sum(w), 4) AS total, count(*) FILTER (WHERE w < u) AS cut FROM c GROUP BY kind"),
    "num_bucket_example": (example_buckets, f"""WITH {EVENT_SQL}, c AS (SELECT *, {pick_sql('k', ('good', 'degraded', 'unusable'))} AS q, (k & 1) > 0 AS fm, (k & 2) > 0 AS lx, (k & 4) > 0 AS fired FROM ev) SELECT CASE
WHEN (fm AND kind = 'error') OR (NOT fm AND kind = 'signup') OR (q = 'good' AND fired AND fm <> lx) THEN 'disagreement'
WHEN q = 'unusable' OR (q <> 'good' AND NOT ((fm AND u >= 0.5e0) OR lx OR 1 - u >= 0.6e0 OR kind IN ('error', 'signup')) AND kind <> 'purchase') THEN 'uncertain'
WHEN ((fm AND u >= 0.7e0) OR kind = 'purchase') AND kind <> 'error' THEN 'positive' ELSE 'negative' END AS bucket, count(*) AS n FROM c GROUP BY 1"""),
    "topk_evi": (flip_value, f"WITH {EVENT_SQL} SELECT event_id, round((1 - abs(2 * u - 1)) / (1e0 + k), 9) AS evi FROM ev ORDER BY evi DESC, event_id LIMIT 20"),
    "js_payload": (certainty, f"WITH {EVENT_SQL} SELECT k, CASE WHEN k % 4 = 0 THEN 0.9e0 WHEN k % 4 = 2 THEN CAST(k AS DOUBLE) ELSE 0e0 END AS certainty, count(*) AS n FROM ev GROUP BY k"),
    "js_cohort_identity": (cohort_identity, f"WITH {EVENT_SQL} SELECT '{{\"appBuild\":\"1\",\"promptLabel\":\"' || kind || '\",\"schemaHash\":\"h' || (k % 3) || '\"}}' AS cohort, count(*) AS n FROM ev GROUP BY 1"),
    "js_scope_parse": (scopes, f"WITH {EVENT_SQL} SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n, sum(floor(v) - k) AS covered FROM ev WHERE kind <> 'error' AND floor(v) > k GROUP BY 1"),
    "id_hash_version": (version_hashes, None),
    "num_hamming": (hamming, f"WITH {BITS_SQL} SELECT a.vec_id, CAST(CASE WHEN a.b >= 9223372036854775808::HUGEINT THEN a.b - 18446744073709551616::HUGEINT ELSE a.b END AS BIGINT) AS bits, CAST(bit_count(xor(a.b, c.b)) AS BIGINT) AS distance FROM bits a JOIN bits c ON c.vec_id = a.vec_id + 1"),
    "num_canberra_sim": (canberra, "WITH p AS (SELECT a.vec_id, list_zip(a.embedding, b.embedding) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(exp(-4 * list_avg(list_transform(z, lambda x: abs(abs(x[1]::DOUBLE) - abs(x[2]::DOUBLE)) / (abs(x[1]::DOUBLE) + abs(x[2]::DOUBLE) + 1e-6)))), 6) AS similarity FROM p"),
}
