"""Readers on small files; streams against the same functions on tables."""

import pytest
from pyspark.sql import functions as F

from spanloom.sources import feeds
from spanloom.streaming import sessions as st


def test_opml(spark, tmp_path):
    (tmp_path / "a.opml").write_text("<opml version='2.0'><body><outline text='Folder'><outline text=\"A &amp; B\" xmlUrl=\"http://a/f?x=1&amp;y=2\"/></outline><outline text='no address'/><outline xmlUrl='http://b/' title='B > C'/></body></opml>")
    (tmp_path / "b.opml").write_text('<opml><body><outline text="again" xmlUrl="http://b/"/></body></opml>')
    (tmp_path / "c.opml").write_text("<opml><body><outline xmlUrl='http://broken/'>")
    got = {tuple(r) for r in feeds.read_opml(spark, str(tmp_path)).collect()}
    assert got == {("http://a/f?x=1&y=2", "A & B"), ("http://b/", "B > C")}


def test_opml_round_trip(spark):
    rows = [(1, "http://a/?x=1&y=2", "A <&> \"B\" 'C'"), (1, "http://b/", None), (1, "http://b/", "  "), (2, "https://c/", "C"), (2, None, "none")]
    written = feeds.write_outlines(spark.createDataFrame(rows, "k int, feed_url string, title string"), "k")
    assert written.where("k = 2").first().xml == '<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>Subscriptions</title></head>\n  <body>\n    <outline type="rss" text="C" xmlUrl="https://c/"/>\n  </body>\n</opml>\n'
    again = {tuple(r) for r in feeds.parse_outlines(written, "xml", "k").collect()}
    assert again == {(1, "http://a/?x=1&y=2", "A <&> \"B\" 'C'"), (1, "http://b/", "http://b/"), (2, "https://c/", "C")}


def test_outlines_of_any_kind(spark):
    deep = "<outline text='f'>" * 12 + "<outline xmlurl=' http://deep/ ' text='d'/>" + "</outline>" * 12
    documents = [
        (1, f"<opml><body><!-- <outline xmlUrl='http://no/'/> -->{deep}<outline XMLURL='http://x/' title='' text='t'/></body></opml>"),
        (2, "<opml><body><outline xmlUrl='relative/path'/><outline xmlUrl=''/></body></opml>"),
        (3, "<html/>"), (4, None), (5, ""), (6, "<opml><body><outline xmlUrl='http://a/'>"), (7, "<!DOCTYPE a [<!ENTITY e 'x'>]><opml><body><outline xmlUrl='http://a/' text='&e;'/></body></opml>"),
    ]
    got = {tuple(r) for r in feeds.parse_outlines(spark.createDataFrame(documents, "k int, x string"), "x", "k").collect()}
    assert got == {(1, "http://deep/", "d"), (1, "http://x/", None)}


RSS = """<?xml version="1.0"?><rss xmlns:itunes="i" xmlns:podcast="p" xmlns:content="c"><channel><title> A &amp; B </title><title>later</title>
<image><title>picture</title><link>http://picture/</link></image><link>/home</link><description>first</description><description><![CDATA[<b>last</b>]]></description>
<itunes:image href="u.png"/><itunes:owner><itunes:email>me@x.example</itunes:email></itunes:owner><itunes:category text="News"/>
<item><title>one</title><guid isPermaLink="false">g</guid><itunes:duration>02:30</itunes:duration><pubDate>Mon, 1 Jan 2024 00:00:00 +0200</pubDate><itunes:episode>7</itunes:episode>
<podcast:chapters url="c.json"/><podcast:chapter startTime="1:00" title="late" href="//x.example/c"/><podcast:chapter startTime="5" title="soon"/><content:encoded><![CDATA[<p>notes</p>]]></content:encoded></item>
<item><title>again</title><guid>g</guid></item>
<item><title>&#x41;&#66;</title><enclosure url="https://y.example/b.mp3" type="audio/mpeg" length="many"/><itunes:summary>short</itunes:summary></item>
<item><title>bare</title></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(RSS[:-20])
    (tmp_path / "c.xml").write_text("<rss><channel><link>http://nothing/</link></channel></rss>")
    parsed = {r.path[-5:]: r for r in feeds.read_feeds(spark, str(tmp_path)).collect()}
    assert {p: r.broken for p, r in parsed.items()} == {"a.xml": False, "b.xml": True, "c.xml": True}
    assert [r.episodes for p, r in parsed.items() if p != "a.xml"] == [[], []]
    feed = parsed["a.xml"].feed
    assert (feed.title, feed.site_url, feed.description, feed.artwork_url, feed.owner_email, feed.categories, feed.author) == ("A & B", "/home", "<b>last</b>", "u.png", "me@x.example", ["News"], "")
    one, two, three = parsed["a.xml"].episodes
    assert (one.guid, one.title, one.duration, one.number, one.notes, one.chapters_url, str(one.published)) == ("g", "one", 150.0, 7, "<p>notes</p>", "c.json", "2023-12-31 22:00:00")
    assert [(c.start, c.title, c.url) for c in one.chapters] == [(60.0, "late", "//x.example/c"), (5.0, "soon", None)]
    assert (two.guid, two.title, two.length, two.description, two.notes) == ("https://y.example/b.mp3", "AB", None, "short", "short")
    assert three.guid == "A & B::bare"


def test_addresses_dates_lengths(spark):
    base = "https://x.example/a/feed.xml?q=1"
    cases = {"b.mp3": "https://x.example/a/b.mp3", "/b.mp3": "https://x.example/b.mp3", "//y.example/b": "https://y.example/b", "http://z/": "http://z/", "": None, None: None}
    rows = spark.createDataFrame([(k, base) for k in cases] + [("b", "https://x.example"), ("b", None)], "u string, b string")
    assert [r[0] for r in rows.select(feeds.resolved(F.col("u"), F.col("b"))).collect()] == [*cases.values(), "https://x.example/b", "b"]
    times = spark.createDataFrame([(x,) for x in ("1:2:3", "2:3", "3.5", "1:2:3:4", "x:1", "", None)], "x string")
    assert [r[0] for r in times.select(feeds.duration(F.col("x"))).collect()] == [3723.0, 123.0, 3.5, None, None, None, None]
    dates = spark.createDataFrame([(x,) for x in ("Tuesday, 02 Jan 2024 03:04:05 PST", "2024-01-02T03:04:05+01:00", "2024-01-02T03:04:05", "yesterday", None)], "x string")
    assert [r[0] and str(r[0]) for r in dates.select(feeds.published(F.col("x"))).collect()] == ["2024-01-02 11:04:05", "2024-01-02 02:04:05", None, None, None]


def test_chapters(spark):
    documents = [
        '{"version": "1", "chapters": [{"startTime": 9, "title": "b"}, {"startTime": 1.5, "endTime": 3, "title": "a"}, {"startTime": -1}, {"startTime": 4, "endTime": 4}, {"startTime": 2, "toc": false}]}',
        "not json", None, '{"chapters": []}', '{"chapters": [{"title": "no start"}]}',
    ]
    rows = spark.createDataFrame([(x,) for x in documents], "x string").select(feeds.chapters(F.col("x")).alias("c"))
    assert [[tuple(c) for c in r.c] for r in rows.collect()] == [[(1.5, 3.0, "a"), (9.0, None, "b")], [], [], [], []]
    closed = rows.select(feeds.closed_chapters(F.col("c"), F.lit(20.0)).alias("c")).first().c
    assert [tuple(c) for c in closed] == [(1.5, 9.0, "a"), (9.0, 20.0, "b")]


def test_feed_text(spark):
    texts = ["<script>x<y</script>a <b>b</b> &amp;lt; &#233;\u00a0\n<style>p{}</style>c", "<p></p>", None, "", "x" * 5000]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(feeds.feed_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["a b &lt; é c", None, None, None, "x" * 4000]


def test_files_by_size(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "repeat('x', cast(id as int)) as v").coalesce(1)
    feeds.write_events(rows, f"{tmp_path}/out", bytes_a_file=500)
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("**/*.txt")]
    assert len(sizes) > 10 and max(sizes) <= 500
    assert feeds.read_events(spark, f"{tmp_path}/out", "id long, v string").count() == 100


def test_event_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, kind string")
    feeds.write_events(rows, f"{tmp_path}/out", 1)
    (tmp_path / "out" / "more.json").write_text('{"id": 4, "kind": "d"}\nnot json\n{"id": "x"}\n')
    got = feeds.read_events(spark, f"{tmp_path}/out", "id long, kind string").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4]


@pytest.mark.parametrize("operator", [st.sessions, st.windowed_counts])
def test_streams(spark, data, operator, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    name = operator.__name__
    query = operator(stream, ["user_id"]).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.table(name).collect()}
    finally:
        query.stop()
    want = {tuple(r) for r in operator(events, ["user_id"]).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("which", ["segments", "hypotheses"])
def test_machines(spark, tmp_path, which):
    from spanloom.operators import segments as sg
    from spanloom.streaming import machines as mc

    kinds = ["sponsor", "body", "url", "return", "disclosure"]
    rows = [(k, float(s), float(s + 4), ((s * 37 + k * 11) % 100) / 100, kinds[(s + k) % 5]) for k in range(3) for s in range(0, 1500, 5) if (s // 100 + k) % 3]
    frame = spark.createDataFrame(rows, "k long, start double, end double, score double, kind string").withColumn("weight", F.lit(1.0)).withColumn("ts", F.timestamp_seconds(F.col("start") + 1_700_000_000))
    far = frame.limit(1).withColumns({"k": F.lit(99).cast("long"), "ts": F.timestamp_seconds(F.lit(1_800_000_000))})
    for i, part in enumerate([frame.where("start < 700"), frame.where("start >= 700"), far]):  # the last one ends all others
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    form = (lambda m, df: m.hysteresis_segments(df, ["k"], "k long", near=90.0)) if which == "segments" else (lambda m, df: m.hypotheses(df, ["k"], "k long"))
    query = form(mc, stream).writeStream.outputMode("append").format("memory").queryName(which).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        got = {tuple(r)[:5] for r in spark.table(which).collect() if r.k != 99}
    finally:
        query.stop()
    want = {tuple(r)[:5] for r in form(sg, frame).collect()}
    assert got == want and len(want) > 3
