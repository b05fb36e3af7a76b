"""Queries of the joins, over events, documents, vectors and the star schema."""

from __future__ import annotations


from pyspark.sql import functions as F

from spanloom.functions import scores as sc
from spanloom.operators import intervals as iv
from spanloom.operators import joins as jn
from spanloom.plans.common import EVENT_SQL, SPAN_SQL, events, second_spans, table
from spanloom.plans.score_queries import BITS_SQL, bits

_USER = ["user_id"]
_LEXICON = ((1, "on"), (2, "der"), (3, "que"), (4, "the"), (5, "los"))
_TERMS = ("the", "that")
_HOURS = 3600


def left_anti(spark, sf_dir):
    """Orders that have no returned line."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def full_text(spark, sf_dir):
    return jn.term_search(table(spark, sf_dir, "documents"), "doc_id", _TERMS)


def lexicon(spark, sf_dir):
    entries = spark.createDataFrame(_LEXICON, "entry int, term string")
    return jn.first_entries(table(spark, sf_dir, "documents"), "doc_id", entries)


def ordinal_overlap(spark, sf_dir):
    """Closed ranges of ordinals: errors with their four neighbours against purchases with two."""
    around = lambda kind, n: second_spans(spark, sf_dir, kind).select("user_id", "event_id", (F.col("ord") - n).alias("start"), (F.col("ord") + n + 1).alias("end"))
    return iv.overlap_join(around("error", 2), around("purchase", 1), _USER, bucket=16).groupBy("user_id").agg(F.count("*").alias("pairs"), F.countDistinct("a.event_id").alias("errors"))


def correction_scope(spark, sf_dir):
    """Corrections, whose scope is a text, and the purchases that their spans overlap."""
    scope = F.concat_ws(":", F.lit("exactTimeSpan"), F.col("user_id").cast("string"), F.col("start").cast("string"), (F.col("start") + F.col("k") * 60).cast("string"))
    corrections = second_spans(spark, sf_dir, "error").select("event_id", sc.scope_span(scope).alias("s")).where("s IS NOT NULL").select("event_id", F.col("s.id").cast("long").alias("user_id"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))
    pairs = iv.overlap_join(corrections, second_spans(spark, sf_dir, "purchase"), _USER, bucket=6 * _HOURS)
    return pairs.select(F.col("a.event_id").alias("correction"), F.col("b.event_id").alias("purchase"), iv.overlap_length().alias("shared"))


def best_decision(spark, sf_dir):
    """Each purchase's view or click of the largest overlap; ties to the smaller id."""
    return jn.best_overlap(second_spans(spark, sf_dir, "purchase"), second_spans(spark, sf_dir, "view", "click"), _USER, 6 * _HOURS, [-F.col("shared"), F.col("b.event_id")], {"best": F.col("b.event_id"), "shared": F.col("shared")})


def point_in_atom(spark, sf_dir):
    """The first span of views and clicks that holds an error's second."""
    points = second_spans(spark, sf_dir, "error").withColumn("end", F.col("start") + 1)
    return jn.best_overlap(points, second_spans(spark, sf_dir, "view", "click"), _USER, 6 * _HOURS, [F.col("b.start"), F.col("b.event_id")], {"atom": F.col("b.event_id"), "ord": F.col("b.ord")})


def open_interval(spark, sf_dir):
    """Errors by the run of signups that holds them; a run that has not ended (k below 20) holds all later ones."""
    points = second_spans(spark, sf_dir, "error").select("user_id", "event_id", "start", (F.col("start") + 1).alias("end"))
    runs = second_spans(spark, sf_dir, "signup").withColumn("finished", F.when(F.col("k") >= 20, F.col("end"))).select("user_id", "event_id", "start", (F.coalesce("finished", F.lit(jn.OPEN_END)) + 1).alias("end"))
    held = iv.overlap_join(points, runs, _USER, bucket=6 * _HOURS).groupBy(F.col("a.event_id").alias("event_id")).agg(F.count("*").alias("n"))
    return points.join(held, "event_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_runs")).agg(F.count("*").alias("n"))


def audit_classes(spark, sf_dir):
    """Views by what purchases of the same user and day follow or precede them; a late or timely one counts twice, as followed and as such."""
    day = F.floor(F.col("at") / 86_400_000_000)
    rows = events(spark, sf_dir).withColumn("day", day)
    near = jn.nearest_in_time(rows.where("kind = 'view'").select("user_id", "day", "event_id", "at"), rows.where("kind = 'purchase'"), ["user_id", "day"])
    gap = F.col("after") - F.col("at")
    classes = F.when(F.col("after").isNotNull(), F.array(F.lit("followed"), F.when(gap <= 4 * _HOURS * 1_000_000, "followed_in_time").otherwise("followed_late"))).when(F.col("before").isNotNull(), F.array(F.lit("preceded_only"))).otherwise(F.array(F.lit("no_evidence")))
    return near.select(F.explode(classes).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def semi_near(spark, sf_dir):
    """Views within an hour of a purchase on either side."""
    rows = events(spark, sf_dir)
    near = jn.nearest_in_time(rows.where("kind = 'view'").select("user_id", "event_id", "at"), rows.where("kind = 'purchase'"), _USER)
    hour = _HOURS * 1_000_000
    return near.where((F.col("after") - F.col("at") <= hour) | (F.col("at") - F.col("before") <= hour)).select("event_id", "user_id")


def landmark_nearest(spark, sf_dir):
    """How far each click's expected purchase (an hour later) is off; a user is aligned if half of them drift two hours at most."""
    rows = events(spark, sf_dir)
    expected = rows.where("kind = 'click'").select("user_id", "event_id", (F.col("at") + _HOURS * 1_000_000).alias("at"))
    near = jn.nearest_in_time(expected, rows.where("kind = 'purchase'"), _USER)
    drift = F.least(F.col("after") - F.col("at"), F.col("at") - F.col("before"))
    each = near.groupBy("user_id").agg(F.count("*").alias("landmarks"), F.sum(F.coalesce((drift <= 2 * _HOURS * 1_000_000).cast("long"), F.lit(0))).alias("aligned"))
    return each.withColumn("valid", 2 * F.col("aligned") >= F.col("landmarks"))


def cooccurrence(spark, sf_dir):
    return jn.cooccurrences(events(spark, sf_dir), _USER, ["at", "event_id"], "kind", within=5)


def activity(spark, sf_dir):
    """One row a customer from four keyed sources."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    placed = t("orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))
    named = t("customer").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    return named.join(placed, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), "latest")


def lsh_self(spark, sf_dir):
    """Vectors that share one of eight bands of eight bits and differ in at most 20 bits."""
    return jn.hamming_pairs(bits(spark, sf_dir), "vec_id", "bits", bands=8, most=20)


def knn_hamming(spark, sf_dir):
    """Every tenth vector with up to eleven bits flipped: the nearest stored one within seven bits; every seventh vector is revoked."""
    packed = bits(spark, sf_dir).withColumn("seen", F.col("vec_id"))
    flipped = F.col("bits").bitwiseXOR((F.pow(F.lit(2.0), F.pmod(F.col("vec_id"), F.lit(12))) - 1).cast("long"))
    return jn.nearest_hamming(packed.where("vec_id % 10 = 3").withColumn("bits", flipped), packed.where("vec_id % 7 <> 0"), packed.where("vec_id % 7 = 0"), "vec_id", "bits", most=7)


_SIGNED = "CAST(CASE WHEN b >= 9223372036854775808::HUGEINT THEN b - 18446744073709551616::HUGEINT ELSE b END AS BIGINT)"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda w: w <> ''))"
_NEAREST = "SELECT a.*, (SELECT min(b.tm) FROM ev b WHERE b.user_id = a.user_id AND b.kind = 'purchase' AND b.tm >= a.tm{extra}) AS aft, (SELECT max(b.tm) FROM ev b WHERE b.user_id = a.user_id AND b.kind = 'purchase' AND b.tm <= a.tm{extra}) AS bef"

QUERIES = {
    "join_left_anti_sql": (left_anti, "SELECT o_orderstatus, count(*) AS n FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL GROUP BY 1"),
    "join_fts": (full_text, f"SELECT doc_id FROM documents WHERE list_has_all({_WORDS}, {list(_TERMS)})"),
    "join_broadcast_lexicon": (lexicon, f"WITH lex(entry, term) AS (VALUES {', '.join(map(str, _LEXICON))}), d AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) SELECT doc_id, min(entry) AS entry, arg_min(term, entry) AS term, count(*) AS n_entries FROM d JOIN lex USING (term) GROUP BY doc_id"),
    "join_ordinal_overlap": (ordinal_overlap, f"WITH {SPAN_SQL} SELECT a.user_id, count(*) AS pairs, count(DISTINCT a.event_id) AS errors FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.ord - 2 <= b.ord + 1 AND b.ord - 1 <= a.ord + 2 WHERE a.kind = 'error' AND b.kind = 'purchase' GROUP BY 1"),
    "join_correction_scope": (correction_scope, f"WITH {SPAN_SQL} SELECT a.event_id AS correction, b.event_id AS purchase, least(a.s + a.k * 60, b.e) - greatest(a.s, b.s) AS shared FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.s + a.k * 60 WHERE a.kind = 'error' AND a.k > 0 AND b.kind = 'purchase'"),
    "join_best_decision": (best_decision, f"WITH {SPAN_SQL} SELECT a.user_id, a.event_id, b.event_id AS best, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.kind = 'purchase' AND b.kind IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY shared DESC, b.event_id) = 1"),
    "join_point_in_atom": (point_in_atom, f"WITH {SPAN_SQL} SELECT a.user_id, a.event_id, b.event_id AS atom, b.ord FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s < b.e AND b.s <= a.s WHERE a.kind = 'error' AND b.kind IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.s, b.event_id) = 1"),
    "join_interval_left": (open_interval, f"WITH {SPAN_SQL}, j AS (SELECT a.event_id, count(b.event_id) AS n_runs FROM sp a LEFT JOIN sp b ON a.user_id = b.user_id AND b.kind = 'signup' AND a.s BETWEEN b.s AND coalesce(CASE WHEN b.k >= 20 THEN b.e END, 9000000000000000000) WHERE a.kind = 'error' GROUP BY 1) SELECT n_runs, count(*) AS n FROM j GROUP BY 1"),
    "join_equi_multi_key": (audit_classes, f"WITH {EVENT_SQL}, n AS ({_NEAREST.format(extra=' AND b.tm // 86400000000 = a.tm // 86400000000')} FROM ev a WHERE a.kind = 'view'), c AS (SELECT unnest(CASE WHEN aft IS NOT NULL THEN ['followed', CASE WHEN aft - tm <= 14400000000 THEN 'followed_in_time' ELSE 'followed_late' END] WHEN bef IS NOT NULL THEN ['preceded_only'] ELSE ['no_evidence'] END) AS class FROM n) SELECT class, count(*) AS n FROM c GROUP BY 1"),
    "join_semi_near": (semi_near, f"WITH {EVENT_SQL} SELECT event_id, user_id FROM ev a WHERE kind = 'view' AND EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.kind = 'purchase' AND abs(b.tm - a.tm) <= 3600000000)"),
    "join_landmark_nearest": (landmark_nearest, f"WITH {EVENT_SQL}, d AS (SELECT a.user_id, a.event_id, min(abs(b.tm - a.tm - 3600000000)) AS drift FROM ev a LEFT JOIN ev b ON b.user_id = a.user_id AND b.kind = 'purchase' WHERE a.kind = 'click' GROUP BY 1, 2) SELECT user_id, count(*) AS landmarks, count(*) FILTER (WHERE drift <= 7200000000) AS aligned, 2 * count(*) FILTER (WHERE drift <= 7200000000) >= count(*) AS valid FROM d GROUP BY 1"),
    "join_pairwise_cooc": (cooccurrence, f"WITH {SPAN_SQL} SELECT least(a.kind, b.kind) AS low, greatest(a.kind, b.kind) AS high, count(*) AS n FROM sp a JOIN sp b ON a.user_id = b.user_id AND b.ord - a.ord BETWEEN 1 AND 5 GROUP BY 1, 2"),
    "join_activity": (activity, "WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, count(*) AS orders, coalesce(sum(lines), 0) AS lines, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, n_name, coalesce(orders, 0) AS orders, CAST(coalesce(lines, 0) AS BIGINT) AS lines, latest FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey"),
    "join_lsh_self": (lsh_self, f"WITH {BITS_SQL}, d AS (SELECT b, min(vec_id) AS id FROM bits GROUP BY b), p AS (SELECT d.id, d.b, band, (d.b >> CAST(8 * band AS INTEGER)) & 255 AS part FROM d, range(8) t(band)) SELECT DISTINCT x.id AS a, y.id AS b, CAST(bit_count(xor(x.b, y.b)) AS BIGINT) AS distance FROM p x JOIN p y ON x.band = y.band AND x.part = y.part AND x.id < y.id WHERE bit_count(xor(x.b, y.b)) <= 20"),
    "join_knn_hamming": (knn_hamming, f"WITH {BITS_SQL}, s AS (SELECT vec_id, b, {_SIGNED} AS signed, vec_id % 7 = 0 AS revoked FROM bits), q AS (SELECT vec_id, xor(b, CAST(pow(2, vec_id % 12) - 1 AS HUGEINT)) AS b FROM bits WHERE vec_id % 10 = 3), n AS (SELECT q.vec_id, s.vec_id AS found, bit_count(xor(q.b, s.b)) AS distance, s.signed, s.revoked FROM q JOIN s ON bit_count(xor(q.b, s.b)) <= 7) SELECT vec_id, found, CAST(distance AS BIGINT) AS distance FROM n WHERE NOT revoked AND vec_id NOT IN (SELECT vec_id FROM n WHERE revoked) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, found DESC, signed) = 1"),
}
