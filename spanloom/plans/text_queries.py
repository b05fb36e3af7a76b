"""Queries of the text functions, over documents, conversations, pages and benchmark passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.plans.common import EVENT_SQL, events, table

# The supplied prose has none of the built-in phrases; these families hit it.
FAMILIES = {"sponsor": (1.0, ("the [a-z]+ of", "license")), "promoCode": (1.2, ("[0-9]+ [0-9]+",)), "urlCTA": (0.8, ("[a-z0-9]+ com", "example [a-z]+")), "transitionMarker": (0.3, ("that the", "der die"))}
ROLES = {"opening": "the", "claim": "[0-9]", "proof": "that|dass", "offer": "http|www", "call": "on|que", "close": "end|fin"}
NETWORKS = (("gh", "north"), ("th", "south"), ("en", "west"))
_EMAIL = "[a-z0-9._%+-]+@[a-z0-9-]+[.][a-z0-9.-]+"
_TRIGGERS, _RELATED = (("(?i)@[a-z0-9-]+", "[at]"), ("[0-9]{9,}", "[long]")), (("[0-9]{4}", "[year]"),)


def lexical_scan(spark, sf_dir):
    """Matches by family, the weight of a strong address, and the saturating score of documents with two hits or a strong one."""
    plain = tx.spoken(F.col("text"))
    counts = tx.phrase_counts(F.col("plain"), FAMILIES)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.inline(F.array(F.struct(plain.alias("plain"))))).select("doc_id", *(c.alias(f) for f, c in counts.items()), F.regexp_count(F.lower("text"), F.lit(tx.STRONG_URL)).cast("long").alias("strong"))
    total = F.col("strong") * 95
    hits = F.col("strong")
    for f, (w, _) in FAMILIES.items():
        total, hits = total + F.col(f) * round(w * 100), hits + F.col(f)
    score = F.least(F.lit(0.95), 1 - 1 / (1 + F.lit(0.3) * (total / 100.0)))
    return rows.where((hits >= 2) | (F.col("strong") > 0) | (F.col("promoCode") > 0) | (F.col("sponsor") > 0)).select("doc_id", *FAMILIES, "strong", F.round(score, 6).alias("score"))


def rescan(spark, sf_dir):
    """How many hits each turn's two halves have that the other has not: alternatives of one text scored by one function."""
    half = F.floor(F.length("text") / 2).cast("int")
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.inline(F.array(F.struct(tx.spoken(F.substring(F.col("text"), F.lit(1), half)).alias("a"), tx.spoken(F.substring(F.col("text"), half + 1, F.length("text"))).alias("b")))))
    total = lambda c: sum(tx.phrase_counts(F.col(c), FAMILIES).values(), F.lit(0))
    return turns.select("conv_id", "turn", F.greatest(total("a"), total("b")).alias("best"))


def interpolated_times(spark, sf_dir):
    """When, in turns said at fifteen characters a second, the first ``en`` is said."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    length = F.length(F.coalesce("text", F.lit("")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", length.alias("n"), (F.sum(length).over(order) / 15.0).alias("end"))
    at = F.instr(F.lower("text"), "en")
    return turns.where(at > 0).select("conv_id", "turn", F.round(tx.interpolated(F.col("end") - F.col("n") / 15.0, F.col("end"), at - 1, F.col("n")), 6).alias("at"))


def normalized(spark, sf_dir):
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), " +"), lambda w: (w != "") & ~w.isin(*tx.FILLERS))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(words, " ")).alias("plain_md5"), F.size(words).cast("long").alias("n_words"))


def word_stream(spark, sf_dir):
    """Words of each conversation's turns with their times; counted and summed by conversation."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "").alias("w"))
    words = turns.select("conv_id", "turn", F.size("w").alias("n"), F.posexplode("w").alias("i", "word")).withColumn("at", tx.interpolated(F.col("turn") * 60.0, F.col("turn") * 60.0 + 60, F.col("i"), F.col("n")))
    return words.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.sum("at"), 3).alias("total"), F.min_by("word", F.struct("turn", "i")).alias("first_word"))


def quality_parts(spark, sf_dir):
    """Documents' quality as speech, said at fifteen characters a second."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return tx.speech_quality(rows, "text", F.length("text") / 15.0).select("doc_id", *(F.round(n, 6).alias(n) for n in ("punctuation", "density", "repetition")))


def quality_level(spark, sf_dir):
    """Passages' quality: the weighted parts and how far they agree, and its level."""
    rows = tx.speech_quality(table(spark, sf_dir, "benchmark"), "text", F.length("text") / 15.0)
    four = ["punctuation", "density", "repetition", "word_length"]
    mean = sum((F.col(c) for c in four), F.lit(0.0)) / 4
    spread = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in four), F.lit(0.0)) / 4
    agreement = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * (1 - spread)))
    score = 0.30 * F.col("punctuation") + 0.25 * F.col("density") + 0.20 * F.col("repetition") + 0.15 * F.col("word_length") + 0.10 * agreement
    return rows.select("item_id", F.round(score, 6).alias("score"), tx.quality_level(score).alias("level"))


def rhetoric(spark, sf_dir):
    """Roles by their first sentence, and how well they keep their order; three roles at least."""
    rows = tx.role_flags(table(spark, sf_dir, "benchmark"), "text", ROLES).where(F.size("found") >= 3)
    n, order = F.size("found"), tx.order_consistency("found")
    return rows.select("item_id", n.cast("long").alias("roles"), F.round(0.2 * (0.6 * F.least(0.5 + 0.5 * (n - 3) / 3, F.lit(1.0)) + 0.4 * order), 6).alias("weight"))


def cues(spark, sf_dir):
    """Distinct domains that the texts name, by how many documents do."""
    each = table(spark, sf_dir, "documents").where("text LIKE '%.%'").select("doc_id", F.explode(tx.domains_in(F.col("text"))).alias("domain"))
    return each.groupBy("domain").agg(F.count("*").alias("n"))


def redact_related(spark, sf_dir):
    """Years go only where an address or a long number stands too."""
    clean = tx.redact_related(F.col("text"), _TRIGGERS, _RELATED)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("clean_md5"))


def redact_typed(spark, sf_dir):
    """Addresses numbered by first place, so that one person keeps one letter."""
    rows = table(spark, sf_dir, "documents").where("text LIKE '%@%'").select("doc_id", F.lower("text").alias("text"))
    return tx.numbered(rows, "text", _EMAIL, "PERSON", "out").select("doc_id", F.array_join(F.regexp_extract_all("out", F.lit("\\[PERSON_[A-Z]+\\]"), F.lit(0)), "").alias("people"))


def dai_hosts(spark, sf_dir):
    host = tx.host(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(tx.first_host(F.array(host), NETWORKS).alias("network")).agg(F.count("*").alias("n"))


def asr_vocabulary(spark, sf_dir):
    """Spoken forms of the pages' domains, once each."""
    names = table(spark, sf_dir, "pages").select(tx.domain(F.col("url")).alias("d")).where("d IS NOT NULL").groupBy(tx.spoken_domain(F.col("d")).alias("spoken"))
    return names.agg(F.count("*").alias("n"))


def network_identity(spark, sf_dir):
    """A page's network: its language path where there is one, else its domain; with a confidence."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1)
    rows = table(spark, sf_dir, "pages").select(F.nullif(path, F.lit("")).alias("p"), tx.domain(F.col("url")).alias("d"))
    return rows.groupBy(F.coalesce("p", "d").alias("network"), F.when(F.col("p").isNotNull(), 0.9).otherwise(0.5).alias("confidence")).agg(F.count("*").alias("n"))


def promo_suppress(spark, sf_dir):
    """Documents in which one of the show's own phrases stands as a run of words."""
    own = ("that the", "der die", "que la")
    hit = F.lit(False)
    for phrase in own:
        hit = hit | F.concat(F.lit(" "), F.col("p"), F.lit(" ")).contains(f" {phrase} ")
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("p")).where(hit).select("doc_id")


def boundary_hits(spark, sf_dir):
    """Ends of sentences in each turn: how many, and the confidence that decays with the place."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.regexp_count("text", F.lit("[.!?]")).alias("n")).where("n > 0")
    return turns.select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.round(F.pow(F.lit(0.9), F.col("n") - 1), 6).alias("confidence"))


def phrase_mine(spark, sf_dir):
    """Word pairs of the turns, with the conversations that hold them and their share at a turn's edge; three conversations at least."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]", ""), " +"), lambda w: w != "")
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.inline(F.array(F.struct(words.alias("w"))))).where(F.size("w") >= 2)
    pairs = turns.select("conv_id", F.size("w").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("i", "phrase"))
    edge = (F.col("i") < 3) | (F.col("i") >= F.col("n") - 4)
    each = pairs.groupBy("phrase", "conv_id").agg(F.count("*").alias("c"), F.sum(edge.cast("long")).alias("e"))
    mined = each.groupBy("phrase").agg(F.count("*").alias("support"), F.sum("c").alias("n"), F.round(F.sum("e") / F.sum("c"), 6).alias("affinity"))
    return mined.where("support >= 3 AND affinity >= 0.3")


def music_words(spark, sf_dir):
    """Regions without lexical support: spans of likely music in which no click happens."""
    from spanloom.operators import intervals as iv
    from spanloom.plans.common import second_spans

    regions = second_spans(spark, sf_dir).where("k >= 50 AND kind = 'view'")
    backed = iv.overlap_join(regions, second_spans(spark, sf_dir, "click"), ["user_id"], bucket=21_600).select(F.col("a.event_id").alias("event_id"))
    return regions.select("event_id", "user_id").join(backed, "event_id", "left_anti")


_SPOKEN = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_COUNT = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_FAMILY_SQL = ", ".join(f"{' + '.join(_COUNT('p', x) for x in ps)} AS \"{f}\"" for f, (_, ps) in FAMILIES.items())
_STRONG_SQL = tx.STRONG_URL.replace("'", "''")
_TOTAL_SQL = " + ".join([f'"{f}" * {round(w * 100)}' for f, (w, _) in FAMILIES.items()] + ["strong * 95"])
_ASCII_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: w <> '')"
_FILLER_SQL = ", ".join(f"'{w}'" for w in tx.FILLERS)
_HOST_SQL = "lower(regexp_extract(CASE WHEN regexp_matches(lower(u), '^https?://') THEN u ELSE 'https://' || u END, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
_TWO_SQL = ", ".join(f"'{x}'" for x in tx.TWO_PART)
DOMAIN_SQL = f"SELECT *, CASE WHEN regexp_matches(h, '^[0-9.]*$') OR len(l) < 2 THEN NULL WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN ({_TWO_SQL}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS d FROM (SELECT *, string_split(h, '.') AS l FROM (SELECT *, {_HOST_SQL} AS h FROM {{source}}))"
_HALF = "substring(text, {a}, {b})"
_ANY = lambda t: " + ".join(_COUNT(t, x) for _, ps in FAMILIES.values() for x in ps)
_SENTENCES = "list_filter(regexp_split_to_array(lower(text), '[.!?]+'), lambda s: trim(s) <> '')"
_PARTS = """q0 AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w, length(text) / 15 AS sec FROM {source}), q AS (SELECT *, len(w) AS n, len(w) / nullif(sec, 0) AS rate, length(regexp_replace(text, '[^.!?]', '', 'g')) AS ends FROM q0),
bg AS (SELECT {key}, sum(c) FILTER (WHERE c > 2) AS rep FROM (SELECT {key}, lower(w[i]) || ' ' || lower(w[i + 1]) AS p, count(*) AS c FROM (SELECT *, unnest(range(1, n)) AS i FROM q) GROUP BY 1, 2) GROUP BY 1),
parts AS (SELECT q.*, CASE WHEN n < 5 THEN 0.5e0 ELSE greatest(0, least(1, 1 - abs(ends / greatest(1, n / 20) - 1) * 0.5e0)) END AS punctuation, CASE WHEN sec <= 0 THEN 0e0 WHEN rate BETWEEN 1.5 AND 4 THEN 1e0 WHEN rate BETWEEN 1 AND 5 THEN 0.6e0 WHEN rate BETWEEN 0.5 AND 6 THEN 0.3e0 ELSE 0e0 END AS density, CASE WHEN n < 10 THEN 0.8e0 ELSE greatest(0, 1 - coalesce(rep, 0) / (n - 1) * 3) END AS repetition FROM q LEFT JOIN bg USING ({key}))"""

QUERIES = {
    "txt_lexical_scan": (lexical_scan, f"WITH d AS (SELECT doc_id, {_SPOKEN} AS p, len(regexp_extract_all(lower(text), '{_STRONG_SQL}')) AS strong FROM documents), c AS (SELECT doc_id, strong, {_FAMILY_SQL} FROM d) SELECT doc_id, {', '.join(FAMILIES)}, strong, round(least(0.95e0, 1 - 1 / (1 + 0.3e0 * (({_TOTAL_SQL}) / 100e0))), 6) AS score FROM c WHERE sponsor + \"promoCode\" + \"urlCTA\" + \"transitionMarker\" + strong >= 2 OR strong > 0 OR \"promoCode\" > 0 OR sponsor > 0"),
    "txt_rescan": (rescan, f"WITH h AS (SELECT conv_id, turn, trim(regexp_replace(lower(substring(text, 1, length(text) // 2)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(substring(text, length(text) // 2 + 1)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS b FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, greatest({_ANY('a')}, {_ANY('b')}) AS best FROM h"),
    "txt_interpolate_time": (interpolated_times, "WITH t AS (SELECT *, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) / 15e0 AS e FROM conversations) SELECT conv_id, turn, round(e - n / 15e0 + n / 15e0 * ((instr(lower(text), 'en') - 1) / n), 6) AS at FROM t WHERE instr(lower(text), 'en') > 0"),
    "txt_normalize_minhash": (normalized, f"WITH w AS (SELECT item_id, list_filter({_ASCII_WORDS}, lambda w: w NOT IN ({_FILLER_SQL})) AS w FROM benchmark) SELECT item_id, md5(array_to_string(w, ' ')) AS plain_md5, len(w) AS n_words FROM w"),
    "txt_word_stream": (word_stream, "WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM conversations WHERE text IS NOT NULL), x AS (SELECT conv_id, turn, i, w[i] AS word, turn * 60 + 60e0 * (i - 1) / len(w) AS tm FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)) SELECT conv_id, count(*) AS n, round(sum(tm), 3) AS total, arg_min(word, turn * 1000000 + i) AS first_word FROM x GROUP BY 1"),
    "txt_quality": (quality_parts, "WITH " + _PARTS.format(source="(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", key="doc_id") + " SELECT doc_id, round(punctuation, 6) AS punctuation, round(density, 6) AS density, round(repetition, 6) AS repetition FROM parts"),
    "txt_quality_level": (quality_level, None),
    "txt_rhetoric": (rhetoric, None),
    "txt_cues": (cues, "WITH a AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '" + tx.ADDRESS.replace("'", "''") + "'), lambda m: regexp_replace(m, '(?i)^((https?://)?)www[.]', '\\1'))) AS u FROM documents WHERE contains(text, '.')) SELECT d AS domain, count(*) AS n FROM (SELECT DISTINCT doc_id, d FROM (" + DOMAIN_SQL.format(source="a") + ") WHERE d IS NOT NULL) GROUP BY 1"),
    "txt_redact_related": (redact_related, "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?i)@[a-z0-9-]+') OR regexp_matches(text, '[0-9]{9,}') THEN regexp_replace(regexp_replace(regexp_replace(text, '(?i)@[a-z0-9-]+', '[at]', 'g'), '[0-9]{9,}', '[long]', 'g'), '[0-9]{4}', '[year]', 'g') ELSE text END) AS clean_md5 FROM documents"),
    "txt_redact_typed": (redact_typed, f"WITH m AS (SELECT doc_id, regexp_extract_all(lower(text), '{_EMAIL}') AS x FROM documents WHERE text LIKE '%@%') SELECT doc_id, array_to_string(list_transform(x, lambda e: '[PERSON_' || chr(CAST(64 + list_position(list_filter(x, lambda y, i: list_position(x, y) = i), e) AS INTEGER)) || ']'), '') AS people FROM m"),
    "txt_dai_host": (dai_hosts, f"WITH p AS (SELECT {_HOST_SQL.replace('u,', 'u,')} AS h FROM (SELECT url AS u FROM pages)) SELECT CASE WHEN contains(h, 'gh') THEN 'north' WHEN contains(h, 'th') THEN 'south' WHEN contains(h, 'en') THEN 'west' ELSE 'unknown' END AS network, count(*) AS n FROM p GROUP BY 1"),
    "txt_asr_vocab": (asr_vocabulary, f"SELECT replace(d, '.', ' dot ') AS spoken, count(*) AS n FROM ({DOMAIN_SQL.format(source='(SELECT url AS u FROM pages)')}) WHERE d IS NOT NULL GROUP BY 1"),
    "txt_network_identity": (network_identity, f"WITH x AS (SELECT nullif(regexp_extract(u, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1), '') AS p, d FROM ({DOMAIN_SQL.format(source='(SELECT url AS u FROM pages)')})) SELECT coalesce(p, d) AS network, CASE WHEN p IS NOT NULL THEN 0.9e0 ELSE 0.5e0 END AS confidence, count(*) AS n FROM x GROUP BY 1, 2"),
    "txt_promo_suppress": (promo_suppress, "SELECT doc_id FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS p FROM documents) WHERE contains(p, ' that the ') OR contains(p, ' der die ') OR contains(p, ' que la ')"),
    "win_stable_boundary_hits": (boundary_hits, "SELECT conv_id, turn, n, round(pow(0.9e0, n - 1), 6) AS confidence FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[.!?]')) AS n FROM conversations) WHERE n > 0"),
    "txt_ngram_mine": (phrase_mine, f"WITH t AS (SELECT conv_id, turn, {_ASCII_WORDS} AS w FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, w[i] || ' ' || w[i + 1] AS phrase, i - 1 < 3 OR i - 1 >= len(w) - 4 AS edge FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)) SELECT phrase, count(DISTINCT conv_id) AS support, count(*) AS n, round(count(*) FILTER (WHERE edge) / count(*), 6) AS affinity FROM p GROUP BY 1 HAVING count(DISTINCT conv_id) >= 3 AND round(count(*) FILTER (WHERE edge) / count(*), 6) >= 0.3"),
    "flt_music_gate": (music_words, "WITH " + EVENT_SQL + ", sp AS (SELECT *, tm // 1000000 AS s, tm // 1000000 + CAST(floor(v * 60) AS BIGINT) AS e FROM ev) SELECT event_id, user_id FROM sp a WHERE k >= 50 AND kind = 'view' AND NOT EXISTS (SELECT 1 FROM sp b WHERE b.user_id = a.user_id AND b.kind = 'click' AND a.s < b.e AND b.s < a.e)"),
}
