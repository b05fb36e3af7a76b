"""Queries of feeds, subscription lists and chapters. The documents are written from the tables first: a conversation is a
feed with its turns as episodes, a nation's suppliers are a subscription list; then they are parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.text import ENTITIES
from spanloom.plans.common import pick, pick_sql, table
from spanloom.sources import feeds

_DATES = ("Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0100", "Tue, 2 Jan 2024 03:04:05 EST", "2024-01-02T03:04:05.500Z", "2024-01-02", "soon")
_SECONDS = (1704164645, 1704161045, 1704182645, 1704164645, 1704153600, None)
_LENGTHS = ("1:02:03", "62:03", "3723.5", "1:2:3:4", "")
_IN_SECONDS = (3723.0, 3723.0, 3723.5, None, None)


def _written(spark, sf_dir):
    """conv_id, xml: a feed of each conversation; every seventh breaks off."""
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    half = F.floor(F.col("turn") / 2)
    item = F.concat(
        F.lit("<item><!-- <title>none</title> --><title><![CDATA[<"), F.coalesce("role", F.lit("")), F.lit("> & "), F.col("turn").cast("string"), F.lit(']]></title><guid isPermaLink="false">g&#45;'), half.cast("string"),
        F.lit("</guid><pubDate>"), pick(F.col("turn"), _DATES), F.lit("</pubDate><itunes:duration>"), pick(F.col("turn"), _LENGTHS), F.lit('</itunes:duration><enclosure url="a/'), F.col("turn").cast("string"), F.lit('.mp3" length="12"/><description>'), escaped, F.lit("</description></item>"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", item.alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "item"))), lambda x: x["item"]), "\n")
    name = F.col("conv_id").cast("string")
    head = F.concat(F.lit('<?xml version="1.0"?><rss xmlns:itunes="i"><channel><title>Show '), name, F.lit(" &amp; more</title><link>https://cast.example/"), name, F.lit('</link><image><link>https://pictures.example/</link></image><itunes:category text="Talk"/><itunes:category text=""/><itunes:owner><itunes:email>o'), name, F.lit("@cast.example</itunes:email></itunes:owner>"))
    whole = rows.groupBy("conv_id").agg(items.alias("items")).select("conv_id", F.concat(head, "items", F.lit("</channel></rss>")).alias("xml"))
    return whole.withColumn("xml", F.when(F.col("conv_id") % 7 == 3, F.left("xml", F.length("xml") - 10)).otherwise(F.col("xml")))


def _parsed(spark, sf_dir):
    return feeds.parse_feeds(_written(spark, sf_dir), "xml", F.concat(F.lit("https://cast.example/feeds/"), F.col("conv_id").cast("string"), F.lit(".xml")))


def feed_list(spark, sf_dir):
    return _parsed(spark, sf_dir).select("conv_id", "broken", "feed.title", "feed.site_url", "feed.owner_email", F.array_join("feed.categories", ",").alias("categories"), F.size("episodes").alias("n"))


def episode_list(spark, sf_dir):
    found = feeds.episodes(_parsed(spark, sf_dir), "conv_id")
    return found.select("conv_id", "guid", "title", "url", F.unix_seconds("published").alias("published"), "duration", F.md5(F.coalesce("description", F.lit(""))).alias("description_md5"))


def subscriptions(spark, sf_dir):
    """Lists written and read again; suppliers share addresses, and the first of a list's equal ones stays."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("https://feeds.example/?a="), (F.col("s_suppkey") % 40).cast("string"), F.lit("&b=1")).alias("feed_url"), F.concat("s_name", F.lit(" <\"&'>")).alias("title"))
    return feeds.parse_outlines(feeds.write_outlines(rows, "s_nationkey"), "xml", "s_nationkey")


def feed_text(spark, sf_dir):
    clean = feeds.feed_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).alias("n_chars"), F.md5(clean).alias("text_md5"))


def chapter_list(spark, sf_dir):
    """Chapters of each conversation: turns are some seconds apart, some not in the table of contents, some ending before they begin."""
    turn = F.col("turn")
    one = F.struct(((turn * 37) % 100 - 5).cast("double").alias("startTime"), F.when(turn % 3 == 0, ((turn * 37) % 100 + turn * 10 - 20).cast("double")).alias("endTime"), F.col("role").alias("title"), F.when(turn % 4 == 3, False).alias("toc"))
    payload = F.to_json(F.struct(F.lit("1.2").alias("version"), F.array_sort(F.collect_list(one)).alias("chapters")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(payload.alias("payload")).withColumn("payload", F.when(F.col("conv_id") % 9 == 4, F.left("payload", F.length("payload") - 5)).otherwise(F.col("payload")))
    return rows.select("conv_id", F.posexplode(feeds.chapters(F.col("payload"))).alias("n", "c")).select("conv_id", "n", "c.start", "c.end", "c.title")


_NUMBER = lambda values: f"list_extract([{', '.join('NULL' if v is None else repr(v) for v in values)}], CAST(turn % {len(values)} AS INTEGER) + 1)"
_BARE = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"
for _name, _character in ENTITIES:
    _BARE = "replace({}, '{}', '{}')".format(_BARE, _name, _character.replace("'", "''"))
_BARE = f"nullif(left(trim(regexp_replace({_BARE}, '[\\s\\x{{A0}}\\x0B\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')), 4000), '')"

QUERIES = {
    "src_rss": (episode_list, f"SELECT conv_id, 'g-' || (turn // 2) AS guid, '<' || coalesce(role, '') || '> & ' || turn AS title, 'https://cast.example/feeds/a/' || turn || '.mp3' AS url, CAST({_NUMBER(_SECONDS)} AS BIGINT) AS published, CAST({_NUMBER(_IN_SECONDS)} AS DOUBLE) AS duration, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS description_md5 FROM conversations WHERE conv_id % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn, role) = 1"),
    "src_rss_feeds": (feed_list, "SELECT conv_id, conv_id % 7 = 3 AS broken, CASE WHEN conv_id % 7 = 3 THEN '' ELSE 'Show ' || conv_id || ' & more' END AS title, CASE WHEN conv_id % 7 <> 3 THEN 'https://cast.example/' || conv_id END AS site_url, CASE WHEN conv_id % 7 <> 3 THEN 'o' || conv_id || '@cast.example' END AS owner_email, CASE WHEN conv_id % 7 <> 3 THEN 'Talk' END AS categories, CAST(CASE WHEN conv_id % 7 = 3 THEN 0 ELSE count(DISTINCT turn // 2) END AS INTEGER) AS n FROM conversations GROUP BY conv_id"),
    "sink_opml": (subscriptions, "SELECT s_nationkey, 'https://feeds.example/?a=' || (s_suppkey % 40) || '&b=1' AS feed_url, min(s_name || ' <\"&''>') AS title FROM supplier GROUP BY 1, 2"),
    "txt_sanitise_feed": (feed_text, f"SELECT page_id, length({_BARE}) AS n_chars, md5({_BARE}) AS text_md5 FROM pages"),
    "src_chapters": (chapter_list, "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY s, e NULLS FIRST, role) - 1 AS INTEGER) AS n, s AS \"start\", e AS \"end\", role AS title FROM (SELECT conv_id, turn, role, CAST((turn * 37) % 100 - 5 AS DOUBLE) AS s, CASE WHEN turn % 3 = 0 THEN CAST((turn * 37) % 100 + turn * 10 - 20 AS DOUBLE) END AS e FROM conversations) WHERE turn % 4 <> 3 AND s >= 0 AND (e IS NULL OR e > s) AND conv_id % 9 <> 4"),
}
