"""Feeds, subscription lists, chapters and event lines: readers and writers.

XML is parsed by Spark's own reader with a given schema: comments, CDATA, character references and attributes
in any order are its business, and it takes no document type declarations (so no entities of a file's own). A document
that is no well-formed XML is told apart in ``broken`` and gives no rows of its own. Names of feeds are looked up
under their usual prefixes (itunes, podcast, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import decode_entities

_CHAPTER = "array<struct<_startTime string, _title string, _href string, _img string>>"
_ITEM = (
    "title array<string>, guid array<string>, pubDate array<string>, description array<string>, enclosure struct<_url string, _length string, _type string>, `content:encoded` array<string>, "
    "`itunes:summary` array<string>, `itunes:duration` array<string>, `itunes:author` array<string>, `itunes:episode` array<string>, `itunes:image` struct<_href string>, "
    f"`podcast:chapters` struct<_url string>, `podcast:chapter` {_CHAPTER}"
)
_FEED = (
    "channel struct<title array<string>, link array<string>, description array<string>, language array<string>, author array<string>, `itunes:author` array<string>, `itunes:summary` array<string>, "
    f"`itunes:image` struct<_href string>, `itunes:category` array<struct<_text string>>, `itunes:owner` struct<`itunes:email` array<string>>, item array<struct<{_ITEM}>>>, _broken string"
)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "attributePrefix": "_"}
#: Outlines stand in so many folders at most.
DEPTH = 16


def _filled(texts: Column) -> Column:
    """Of an element's occurrences those with text, trimmed."""
    return F.filter(F.transform(texts, lambda x: F.trim(F.regexp_replace(x, "^\\s+|\\s+$", ""))), lambda x: x.isNotNull() & (x != ""))


def _first(texts: Column) -> Column:
    return F.get(_filled(texts), F.lit(0))


def _last(texts: Column) -> Column:
    return F.get(_filled(texts), F.size(_filled(texts)) - 1)


def published(text: Column) -> Column:
    """A feed's date, RFC 822 (any zone, with or without a weekday) or ISO 8601, as a timestamp; null for anything else."""
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9},\\s*", "")
    parsed = [F.try_to_timestamp(plain, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("Z", "z")]
    iso = F.when(plain.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}(T.*(Z|[+-][0-9]{2}:?[0-9]{2}))?$"), F.try_to_timestamp(plain))
    return F.coalesce(iso, *parsed)


def duration(text: Column) -> Column:
    """``HH:MM:SS``, ``MM:SS`` or seconds as seconds; null for anything else."""
    parts = F.filter(F.split(F.trim(text), ":"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    whole = F.aggregate(numbers, F.lit(0.0), lambda total, x: total * 60 + x)
    return F.when(F.size(parts) == 1, F.trim(text).try_cast("double")).when(F.size(parts).isin(2, 3), whole)


def resolved(url: Column, base: Column) -> Column:
    """An address as it is if it has a scheme, else behind that of ``base``."""
    site = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)?", 0)
    relative = F.when(url.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), url)).when(url.startswith("/"), F.concat(site, url))
    behind = F.concat(F.when(folder.endswith("/") & (F.length(folder) > F.length(site)), folder).otherwise(F.concat(site, F.lit("/"))), url)
    return F.when(url == "", None).when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.coalesce(base, F.lit("")).eqNullSafe(""), url).otherwise(F.coalesce(relative, behind))


def parse_feeds(rows: DataFrame, xml: str, base: Column | None = None) -> DataFrame:
    """``rows`` with ``feed`` (title, author, description, language, site_url, artwork_url, owner_email, categories), ``episodes`` and ``broken``.

    Of repeated elements the first title and link count, of others the last. ``broken`` is true for what is no XML,
    and for a document with neither title nor episodes; null for null. An episode without a guid gets its file's address or the titles; of equal
    guids the first stays. ``base`` is the address that relative ones belong to.
    """
    base = F.lit(None).cast("string") if base is None else base
    at = lambda url: resolved(url, base)
    parsed = rows.withColumn("_xml", F.from_xml(F.col(xml), _FEED, _OPTIONS))
    c = F.col("_xml.channel")
    title = F.coalesce(_first(c["title"]), F.lit(""))

    def chapters(e: Column) -> Column:
        return F.transform(F.coalesce(e["podcast:chapter"], F.array()), lambda x: F.struct(F.coalesce(duration(x["_startTime"]), F.lit(0.0)).alias("start"), x["_title"].alias("title"), at(x["_href"]).alias("url"), at(x["_img"]).alias("image")))

    def episode(e: Column) -> Column:
        address, name = at(e["enclosure"]["_url"]), F.coalesce(_last(e["title"]), F.lit(""))
        description = F.coalesce(_last(e["description"]), _first(e["itunes:summary"]))
        dates = F.filter(F.transform(_filled(e["pubDate"]), published), lambda x: x.isNotNull())
        parts = {
            "guid": F.coalesce(_last(e["guid"]), address, F.concat(title, F.lit("::"), name)), "title": name, "url": address, "type": e["enclosure"]["_type"], "length": e["enclosure"]["_length"].try_cast("long"),
            "published": F.get(dates, F.lit(0)), "duration": duration(_last(e["itunes:duration"])), "description": description, "notes": F.coalesce(_last(e["content:encoded"]), description),
            "author": _last(e["itunes:author"]), "number": _last(e["itunes:episode"]).try_cast("int"), "image": at(e["itunes:image"]["_href"]), "chapters_url": at(e["podcast:chapters"]["_url"]), "chapters": chapters(e),
        }
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    every = F.transform(F.coalesce(c["item"], F.array()), episode)
    guids = F.transform(every, lambda e: e["guid"])
    once = F.filter(every, lambda e, i: F.array_position(guids, e["guid"]) == i + 1)
    feed = {
        "title": title, "author": F.coalesce(_last(c["itunes:author"]), _first(c["author"]), F.lit("")), "description": F.coalesce(_last(c["description"]), _first(c["itunes:summary"]), F.lit("")), "language": _last(c["language"]),
        "site_url": at(_first(c["link"])), "artwork_url": at(c["itunes:image"]["_href"]), "owner_email": _first(c["itunes:owner"]["itunes:email"]), "categories": F.filter(F.transform(c["itunes:category"], lambda x: x["_text"]), lambda x: x != ""),
    }
    none = (title == "") & (F.size(F.coalesce(c["item"], F.array())) == 0)
    out = parsed.withColumns({"feed": F.struct(*(v.alias(k) for k, v in feed.items())), "episodes": once, "broken": F.when(F.col(xml).isNotNull(), F.col("_xml._broken").isNotNull() | c.isNull() | none)})
    return out.withColumn("episodes", F.when(F.col("broken"), F.array().cast(out.schema["episodes"].dataType)).otherwise(F.col("episodes"))).drop("_xml")


def episodes(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row an episode of parsed feeds."""
    return parsed.select(*keys, F.explode("episodes").alias("e")).select(*keys, "e.*")


def read_feeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Feed files, one a row, parsed: path, feed, episodes, broken."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_feeds(files, "value").drop("value")


def _outlines(depth: int) -> str:
    return "_xmlUrl string, _title string, _text string" + (f", outline array<struct<{_outlines(depth - 1)}>>" if depth else "")


def parse_outlines(rows: DataFrame, xml: str, *keys: str) -> DataFrame:
    """keys, feed_url, title, of every outline with an absolute address, through up to ``DEPTH`` folders. Of equal addresses of a document the first stays.

    Attribute names count in any case; a title is ``title``, else ``text``, and null where both are empty. What is no XML gives nothing.
    """
    kind = "array<struct<_xmlUrl string, _title string, _text string>>"
    parsed = rows.select(*keys, F.from_xml(F.col(xml), f"body struct<outline array<struct<{_outlines(DEPTH)}>>>, _broken string", _OPTIONS).alias("x"))

    def own(o: Column, depth: int) -> Column:
        """The outline itself and all below it, in the document's order."""
        this = F.array(F.struct(o["_xmlUrl"], o["_title"], o["_text"])).cast(kind)
        return this if not depth else F.concat(this, F.coalesce(F.flatten(F.transform(o["outline"], lambda x: own(x, depth - 1))), F.array().cast(kind)))

    flat = F.flatten(F.transform(F.col("x.body.outline"), lambda o: own(o, DEPTH)))
    each = parsed.where("x._broken IS NULL").select(*keys, F.posexplode(flat).alias("n", "o"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = each.select(*keys, "n", F.trim("o._xmlUrl").alias("feed_url"), text(F.coalesce("o._title", "o._text")).alias("title"))
    return named.where(F.col("feed_url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).groupBy(*keys, "feed_url").agg(F.min_by("title", "n").alias("title"))


def read_opml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """feed_url, title over all subscription lists; of equal addresses the one of the first file by path."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_outlines(files, "value", "path").groupBy("feed_url").agg(F.min_by("title", "path").alias("title"))


def _escaped(text: Column) -> Column:
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def write_outlines(feeds: DataFrame, *keys: str, title: str = "Subscriptions") -> DataFrame:
    """keys, xml: a subscription list of each group's feeds (feed_url, title) by address; the same feeds give the same bytes. Feeds without an address are left out."""
    name = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("feed_url"))
    line = F.concat(F.lit('    <outline type="rss" text="'), _escaped(name), F.lit('" xmlUrl="'), _escaped(F.col("feed_url")), F.lit('"/>\n'))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>'), _escaped(F.lit(title)), F.lit("</title></head>\n  <body>\n"))
    lines = F.array_sort(F.collect_list(F.struct("feed_url", line.alias("line"))))
    body = feeds.where("feed_url IS NOT NULL").groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("body"))
    return body.select(*keys, F.concat(head, "body", F.lit("  </body>\n</opml>\n")).alias("xml"))


def feed_text(raw: Column, longest: int = 4000) -> Column:
    """A description without scripts, styles, tags and entities, white space as single spaces, at most ``longest`` characters; null where nothing is left."""
    bare = F.regexp_replace(raw, "(?is)<(script)[^>]*>.*?</script>|<(style)[^>]*>.*?</style>", "")
    plain = F.trim(F.regexp_replace(decode_entities(F.regexp_replace(bare, "<[^>]+>", "")), "(?U)\\s+", " "))
    return F.nullif(F.left(plain, F.lit(longest)), F.lit(""))


def chapters(payload: Column) -> Column:
    """A chapter document (JSON) as an array of start, end, title in order of start.

    Chapters that are not in the table of contents, that begin before 0 or end before they begin are left out; what is no such document gives an empty array.
    """
    parsed = F.from_json(payload, "version string, chapters array<struct<startTime double, endTime double, title string, toc boolean>>")["chapters"]
    good = F.filter(parsed, lambda c: F.coalesce(c["toc"], F.lit(True)) & (c["startTime"] >= 0) & (c["startTime"] < float("inf")) & F.coalesce((c["endTime"] > c["startTime"]) & (c["endTime"] < float("inf")), F.lit(True)))
    named = F.transform(good, lambda c: F.struct(c["startTime"].alias("start"), c["endTime"].alias("end"), c["title"].alias("title")))
    return F.coalesce(F.array_sort(named, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)), F.array().cast("array<struct<start double, end double, title string>>"))


def closed_chapters(found: Column, length: Column) -> Column:
    """Chapters, in order of start, that end where the next begins, the last at ``length`` if that is known."""
    sorted_ = F.array_sort(F.filter(found, lambda c: (c["start"] >= 0) & (c["start"] < float("inf"))), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    following = F.transform(sorted_, lambda c, i: F.coalesce(F.get(sorted_, i + 1)["start"], F.when(length > 0, length)))
    return F.zip_with(sorted_, following, lambda c, end: F.struct(c["start"].alias("start"), end.alias("end"), c["title"].alias("title")))


def read_events(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines of a given schema; lines that are no such record are dropped, none are inferred."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    whole = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = spark.read.text(paths).select(F.from_json("value", whole, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r._broken IS NULL").select("r.*").drop("_broken")


def write_events(rows: DataFrame, path: str, records_a_file: int = 1_000_000, bytes_a_file: int | None = None) -> None:
    """JSON lines, with a new file after so many records; or, with ``bytes_a_file``, before the record that would pass so many bytes.

    Sizes are summed up within the tasks' own stretches of rows, so no order of all rows is needed; a longer record has a file of its own.
    """
    if bytes_a_file is None:
        rows.write.option("maxRecordsPerFile", records_a_file).mode("append").json(path)
        return
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    def numbered(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, file, used = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if used and used + size + 1 > bytes_a_file:
                    file, used = file + 1, 0
                used += size + 1
                names.append(f"{task:06d}-{file:06d}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names)], names=["value", "part"])

    lines.mapInArrow(numbered, "value string, part string").write.partitionBy("part").mode("append").text(path)
