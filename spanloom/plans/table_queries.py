"""Queries over texts, pages, vectors and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import rollups, scoring

# What the redaction removes, in order; the same patterns serve both dialects.
PATTERNS = (("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "[email]"), ("https?://[^ \\t\\n\\r]+", "[url]"), ("[0-9]{4,}", "[number]"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.redact(F.col("text"), PATTERNS)).alias("redacted_md5"))


def pattern_scan(spark, sf_dir):
    """Weighted pattern families per document, and a saturating score."""
    families = {"email": (1.2, PATTERNS[0][0]), "url": (0.8, PATTERNS[1][0]), "number": (0.3, PATTERNS[2][0])}
    counts = table(spark, sf_dir, "documents").select("doc_id", *(F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, (_, p) in families.items()))
    total = sum((F.col(k) * F.lit(int(w * 10)) for k, (w, _) in families.items()), F.lit(0))
    return counts.where("email + url + number > 0").select("doc_id", *families, F.round(F.least(F.lit(0.95), 1 - 1 / (1 + F.lit(0.3) * (total / 10.0))), 6).alias("score"))


def strip_html(spark, sf_dir):
    clean = tx.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("text_md5"))


def domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(tx.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


def path_shapes(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(tx.path_shape(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))


def ngram_jaccard(spark, sf_dir):
    """Character 4-gram similarity of each pair of neighbouring benchmark items."""
    grams = table(spark, sf_dir, "benchmark").select("item_id", tx.char_ngrams(F.lower("text"), 4).alias("g"))
    after = grams.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("h"))
    return grams.join(after, "item_id").select("item_id", F.round(tx.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


def label_cosine(spark, sf_dir):
    """Cosine of every vector with its label's mean vector."""
    rows = table(spark, sf_dir, "embeddings")
    parts = rows.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))  # as many as dimensions
    return rows.join(means, "label").select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("mean")), 5).alias("cosine"))


def binarised(spark, sf_dir):
    """How many components of each vector lie above its median."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(F.array(F.struct(doubles.alias("v"), F.array_sort(doubles).alias("s")))))  # sorted once a row
    half = (F.size("s") / 2).cast("int")
    middle = F.inline(F.array(F.struct(((F.get("s", half - 1) + F.get("s", half)) / 2).alias("m"))))
    return rows.select("vec_id", "v", middle).select("vec_id", F.array_join(F.transform("v", lambda x: F.when(x > F.col("m"), "1").otherwise("0")), "").alias("bits"))


def spread(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    return rollups.spread(rows, "l_partkey", "l_suppkey", "day", share=0.05, places=3, days=14)


def trimmed(spark, sf_dir):
    return rollups.trimmed(table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice")), ["o_orderpriority"], "o_totalprice", 0.1)


def weighted_share(spark, sf_dir):
    """Part brands' share of quantity, suppliers weighted by their orders."""
    lines = table(spark, sf_dir, "lineitem")
    weight = lines.groupBy("l_suppkey").agg(F.count("*").alias("w"))
    each = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.count("*").alias("f"))
    return rollups.weighted_share(each.join(weight, "l_suppkey"), "p_brand", "l_suppkey", "f", "w")


def coverage_audit(spark, sf_dir):
    """Per order status: orders, those without lines, and the mean covered share of quantity shipped late."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.count("*").alias("n"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum(F.col("n").isNull().cast("long")).alias("without_lines"), F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"), F.round(F.avg(F.col("returned") / F.col("n")), 6).alias("returned_share"))


def revenue_by_nation(spark, sf_dir):
    """Join of five tables with an aggregate; small dimension tables are broadcast when their size allows."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name", "n_name")
    by_order = lines.groupBy("l_orderkey").agg(F.sum("amount").alias("amount"))
    return by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(named, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("amount"), 2).alias("revenue"))


def pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def audit_sample(spark, sf_dir):
    return rollups.audit_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 0.12, "audit-").select("doc_id", "source", "rank")


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(F.col("n_chars") / (F.col("n_chars") + 1000), 3).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def auc_pr(spark, sf_dir):
    return scoring.pr_curve_area(_scored(spark, sf_dir), "score", F.col("quality") == 1)


def confidence_bands(spark, sf_dir):
    scored = _scored(spark, sf_dir).groupBy(scoring.bands(F.col("score")).alias("band"))
    return scored.agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("good"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("precision"))


def duplicates(spark, sf_dir):
    """Texts that several documents hold, by source list."""
    docs = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return docs.where("n > 1")


_CLEAN = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _name, _character in tx.ENTITIES:
    _CLEAN = "replace({}, '{}', '{}')".format(_CLEAN, _name, _character.replace("'", "''"))
_CLEAN = f"trim(regexp_replace({_CLEAN}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
_TWO = ", ".join(f"'{x}'" for x in tx.TWO_PART)
_TRACK = ", ".join(f"'{x}'" for x in tx.TRACKING)
_PATHS = ", ".join(f"'{x}'" for x in tx.PATH_WORDS)
_SCORED = "(SELECT d.doc_id, round(n_chars / (n_chars + 1000), 3) AS score, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_REDACTED = "text"
for _pattern, _put in PATTERNS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_put}', 'g')"
_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"

QUERIES = {
    "txt_redact": (redact, f"SELECT doc_id, md5({_REDACTED}) AS redacted_md5 FROM documents"),
    "txt_pattern_scan": (pattern_scan, f"WITH c AS (SELECT doc_id, {_COUNT(PATTERNS[0][0])} AS email, {_COUNT(PATTERNS[1][0])} AS url, {_COUNT(PATTERNS[2][0])} AS number FROM documents) SELECT doc_id, email, url, number, round(least(0.95::DOUBLE, 1 - 1 / (1 + 0.3::DOUBLE * ((12 * email + 8 * url + 3 * number) / 10.0::DOUBLE))), 6) AS score FROM c WHERE email + url + number > 0"),
    "txt_html_strip": (strip_html, f"SELECT page_id, length({_CLEAN}) AS n_chars, md5({_CLEAN}) AS text_md5 FROM pages"),
    "txt_domains": (domains, f"WITH h AS (SELECT string_split({_HOST}, '.') AS p FROM pages), d AS (SELECT array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three FROM h) SELECT CASE WHEN two IN ({_TWO}) THEN three ELSE two END AS domain, count(*) AS n FROM d GROUP BY 1"),
    "txt_url_canon": (canonical_urls, f"WITH u AS (SELECT page_id, url, CASE WHEN regexp_matches(lower(url), '^https?://') THEN url ELSE 'https://' || url END AS w FROM pages), v AS (SELECT *, regexp_extract(w, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?', 1) AS usr, lower(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+(:[0-9]+)', 1) AS port, regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path, list_filter(string_split(regexp_extract(w, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK})) AS kept, regexp_extract(w, '(#.*)$', 1) AS fragment FROM u) SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://') THEN scheme || '://' ELSE '' END || usr || host || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END || CASE WHEN length(path) > 1 AND path LIKE '%/' THEN substring(path, 1, length(path) - 1) ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || fragment AS canonical FROM v"),
    "txt_path_shape": (path_shapes, f"SELECT '/' || array_to_string(list_transform(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), lambda s: CASE WHEN lower(s) IN ({_PATHS}) THEN lower(s) ELSE '*' END), '/') AS shape, count(*) AS n FROM pages GROUP BY 1"),
    "txt_ngram_jaccard": (ngram_jaccard, "WITH g AS (SELECT item_id, list_distinct(list_transform(generate_series(1, greatest(length(text) - 3, 1)), lambda i: substring(lower(text), i, 4))) AS g FROM benchmark) SELECT a.item_id, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON b.item_id = a.item_id + 1"),
    "num_cosine": (label_cosine, "WITH p AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), m AS (SELECT label, list(m ORDER BY i) AS mean FROM p GROUP BY label) SELECT vec_id, round(greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], mean)), 5) AS cosine FROM embeddings JOIN m USING (label)"),
    "num_binarise": (binarised, "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > m THEN '1' ELSE '0' END), '') AS bits FROM (SELECT *, list_median(embedding::DOUBLE[]) AS m FROM embeddings)"),
    "kv_spread": (spread, "WITH t AS (SELECT count(DISTINCT l_suppkey) AS total FROM lineitem), s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_places, date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS days FROM lineitem GROUP BY l_partkey) SELECT l_partkey, n_places, round(n_places / total, 6) AS ratio, days FROM s, t WHERE round(n_places / total, 6) >= 0.05 AND n_places >= 3 AND days >= 14"),
    "agg_trimmed": (trimmed, "WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), c AS (SELECT *, CASE WHEN n >= 4 THEN greatest(1, floor(n * 0.1)) ELSE 0 END AS cut FROM r) SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM c WHERE r > cut AND r <= n - cut GROUP BY o_orderpriority"),
    "agg_weighted_sponsor": (weighted_share, "WITH w AS (SELECT l_suppkey, count(*) AS w FROM lineitem GROUP BY 1), e AS (SELECT p_brand, l_suppkey, count(*) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand, count(*) AS n_places, round(sum(f * w) / (SELECT sum(w) FROM w), 6) AS share FROM e JOIN w USING (l_suppkey) GROUP BY p_brand HAVING count(*) >= 2"),
    "agg_coverage_audit": (coverage_audit, "WITH l AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY 1) SELECT o_orderstatus, count(*) AS orders, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_lines, CAST(coalesce(sum(returned), 0) AS BIGINT) AS returned, round(avg(returned / n), 6) AS returned_share FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1"),
    "agg_revenue_by_nation": (revenue_by_nation, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "agg_pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "topk_sample_audit": (audit_sample, "WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY sha256('audit-' || doc_id), doc_id) AS rank FROM documents), b AS (SELECT *, greatest(1, ceil(n * 0.10::DOUBLE)) AS low FROM r) SELECT doc_id, source, rank FROM b WHERE rank <= greatest(low, least(greatest(low, floor(n * 0.15::DOUBLE)), round(n * 0.12::DOUBLE)))"),
    "ev_aucpr": (auc_pr, f"WITH s AS (SELECT score, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS tp, count(*) AS n FROM {_SCORED} GROUP BY score), c AS (SELECT score, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, sum(tp) OVER () AS total FROM s), p AS (SELECT score, tp / total AS r, tp / n AS p FROM c), e AS (SELECT r, p, lag(r, 1, 0) OVER (ORDER BY score DESC) AS r0, lag(p, 1, 1) OVER (ORDER BY score DESC) AS p0 FROM p) SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS auc_pr FROM e"),
    "num_bands": (confidence_bands, f"SELECT CASE WHEN score >= 0.8 THEN 'autoSkip' WHEN score >= 0.7 THEN 'confirm' WHEN score >= 0.6 THEN 'mark' WHEN score >= 0.4 THEN 'candidate' ELSE 'none' END AS band, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, round(avg(quality), 6) AS precision FROM {_SCORED} GROUP BY 1"),
    "agg_having_duplicates": (duplicates, "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id, array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE source IS NOT NULL)), ',') AS sources FROM documents GROUP BY md5(text) HAVING count(*) > 1"),
}
