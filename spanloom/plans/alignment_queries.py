"""Queries of byte streams against each other. The streams are made of the texts, as frames of 417 bytes; a stream and its other
version have the text of another document in the middle, each that of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import align
from spanloom.plans.common import table
from spanloom.sources.frames import read_tiles

# a frame: its header (128 kbit/s, 44,100 Hz) and 413 bytes, in hexadecimal
_HEAD, _ROOM = "FFFB9064", 826
_FRAME = 417
#: Ids of documents that are put together with those behind them.
_BLOCK = 16
_KEYS = ["doc_id"]


def _versions(spark, sf_dir):
    """doc_id, a, b: both versions of every document's stream."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("x"))
    padded = F.rpad("x", F.ceil(F.length("x") / _ROOM).cast("int") * _ROOM, F.lit("0"))
    # all headers in one go: a frame cut out by its place would read the text from its beginning
    framed = docs.select("doc_id", F.unhex(F.regexp_replace(padded, f"(.{{{_ROOM}}})", f"{_HEAD}$1")).alias("f"))
    # a document, the next and the next but one come together in blocks of ids, so that each text is sent about once
    block = lambda doc: F.floor(doc / _BLOCK)
    dealt = framed.select(F.explode(F.array_distinct(F.array(*(block(F.col("doc_id") - n) for n in range(3))))).alias("block"), F.struct("doc_id", "f").alias("d"))
    blocks = dealt.groupBy("block").agg(F.collect_list("d").alias("all"))
    own = F.filter("all", lambda d: block(d["doc_id"]).eqNullSafe(F.col("block")))
    later = lambda d, n: F.transform(F.filter("all", lambda o: o["doc_id"] == d["doc_id"] + n), lambda o: o["f"])
    near = blocks.select(F.inline(F.transform(own, lambda d: F.struct(d["doc_id"].alias("doc_id"), d["f"].alias("f"), later(d, 1).alias("next"), later(d, 2).alias("last")))))
    both = near.select("doc_id", "f", F.explode_outer("next").alias("m1"), "last").select("doc_id", "f", "m1", F.explode_outer("last").alias("m2"))
    half = F.floor(F.length("f") / (2 * _FRAME)).cast("int") * _FRAME
    whole = lambda m: F.concat(F.substring("f", F.lit(1), half), F.coalesce(m, F.lit(b"")), F.substring("f", half + 1, F.length("f")))
    return both.select("doc_id", whole(F.col("m1")).alias("a"), whole(F.col("m2")).alias("b"))


def byte_align(spark, sf_dir):
    streams = _versions(spark, sf_dir)
    a, b = (read_tiles(streams, _KEYS, "doc_id long", side) for side in ("a", "b"))
    found = align.slots(a, b, _KEYS, "doc_id long", least_bytes=834)
    return found.select("doc_id", "kind", "a_start", "a_end", "a_bytes", "b_bytes", *(F.round(c, 6).alias(c) for c in ("start", "end", "left_flank", "right_flank")))


def frame_inventory(spark, sf_dir):
    """Of each stream: frames, seconds, bytes, and frames that it holds twice or more."""
    tiles = read_tiles(_versions(spark, sf_dir), _KEYS, "doc_id long", "a").where("is_frame")
    each = tiles.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum("seconds").alias("seconds"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("frames"), F.sum("bytes").alias("bytes"), F.round(F.sum("seconds"), 4).alias("seconds"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))


_FRAMES = f"""d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
f AS (SELECT doc_id, list_transform(range(0, CAST(ceil(length(x) / {_ROOM}) AS BIGINT)), lambda i: '{_HEAD}' || rpad(substr(x, i * {_ROOM} + 1, {_ROOM}), {_ROOM}, '0')) AS f FROM d),
v AS (SELECT f.doc_id, list_concat(f.f[1:len(f.f) // 2], list_concat(coalesce(g.f, []), f.f[len(f.f) // 2 + 1:])) AS a, list_concat(f.f[1:len(f.f) // 2], list_concat(coalesce(h.f, []), f.f[len(f.f) // 2 + 1:])) AS b FROM f LEFT JOIN f g ON g.doc_id = f.doc_id + 1 LEFT JOIN f h ON h.doc_id = f.doc_id + 2)"""
_COMMON = lambda x, y, at: f"(coalesce(list_position(list_transform(range(1, {_ROOM + 9}), lambda k: substr({x}, {at}, 1) = substr({y}, {at}, 1)), false), {_ROOM + 9}) - 1) // 2"
_SECONDS = lambda x: f"{x} / 417e0 * 1152 / 44100"
_ALIGN = f"""{_FRAMES}, ta AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS x FROM v), tb AS (SELECT doc_id, unnest(range(len(b))) AS j, unnest(b) AS x FROM v),
once AS (SELECT * FROM (SELECT doc_id, x, any_value(i) AS i FROM ta GROUP BY 1, 2 HAVING count(*) = 1) JOIN (SELECT doc_id, x, any_value(j) AS j FROM tb GROUP BY 1, 2 HAVING count(*) = 1) USING (doc_id, x)),
dl AS (SELECT DISTINCT doc_id, i - j AS delta FROM once),
eq AS (SELECT doc_id, delta, ta.i, o.i IS NOT NULL AS anchor FROM dl JOIN ta USING (doc_id) JOIN tb ON tb.doc_id = ta.doc_id AND tb.j = ta.i - delta AND tb.x = ta.x LEFT JOIN once o ON o.doc_id = ta.doc_id AND o.i = ta.i AND o.i - o.j = delta),
isl AS (SELECT doc_id, delta, min(i) AS i0, max(i) AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, delta ORDER BY i) AS g FROM eq) GROUP BY doc_id, delta, g HAVING bool_or(anchor)),
edge AS (SELECT doc_id, delta, i0, i1, CASE WHEN i1 + 1 < len(a) AND i1 - delta + 1 < len(b) THEN {_COMMON('a[i1 + 2]', 'b[i1 - delta + 2]', 'k')} ELSE 0 END AS r, CASE WHEN i0 > 0 AND i0 - delta > 0 THEN {_COMMON('a[i0]', 'b[i0 - delta]', f'{_ROOM + 9} - k')} ELSE 0 END AS l FROM isl JOIN v USING (doc_id)),
run AS (SELECT doc_id, i0 * 417 - l AS a0, (i0 - delta) * 417 - l AS b0, (i1 - i0 + 1) * 417 + l + r AS n FROM edge WHERE (i1 - i0 + 1) * 417 + l + r >= 834),
rs AS (SELECT doc_id, list({{'a': a0, 'b': b0, 'n': n}} ORDER BY a0, b0, n) AS rs FROM run GROUP BY 1),
dp AS (SELECT doc_id, rs, 0::BIGINT AS i, []::BIGINT[] AS best, []::BIGINT[] AS prev FROM rs UNION ALL
SELECT doc_id, rs, i + 1, list_append(best, rs[i + 1].n + greatest(coalesce(list_max(cs), 0), 0)), list_append(prev, CASE WHEN list_max(cs) > 0 THEN list_position(cs, list_max(cs)) ELSE 0 END)
FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN rs[j].a + rs[j].n <= rs[i + 1].a AND rs[j].b + rs[j].n <= rs[i + 1].b THEN best[j] ELSE -1 END) AS cs FROM dp WHERE i < len(rs))),
walk AS (SELECT doc_id, rs, prev, list_position(best, list_max(best))::BIGINT AS z FROM dp WHERE i = len(rs) UNION ALL SELECT doc_id, rs, prev, prev[z] FROM walk WHERE prev[z] > 0),
ch AS (SELECT doc_id, rs[z].a AS a0, rs[z].b AS b0, rs[z].n AS n FROM walk),
nx AS (SELECT ch.*, a0 + n AS a1, b0 + n AS b1, lead(a0) OVER w AS na0, lead(b0) OVER w AS nb0, lead(n) OVER w AS nn, row_number() OVER w AS k, len(a) * 417 AS sa, len(b) * 417 AS sb FROM ch JOIN v USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a0)),
gap AS (SELECT doc_id, 'head' AS kind, 0 AS s, a0 AS e, 0 AS t, b0 AS u, 0 AS l, n AS r FROM nx WHERE k = 1 UNION ALL SELECT doc_id, CASE WHEN na0 IS NULL THEN 'tail' WHEN na0 > a1 AND nb0 > b1 THEN 'replaced' WHEN na0 > a1 THEN 'removed_in_b' ELSE 'inserted_in_b' END, a1, coalesce(na0, sa), b1, coalesce(nb0, sb), n, coalesce(nn, 0) FROM nx)
SELECT doc_id, kind, s AS a_start, e AS a_end, e - s AS a_bytes, u - t AS b_bytes, round({_SECONDS('s')}, 6) AS "start", round({_SECONDS('e')}, 6) AS "end", round({_SECONDS('l')}, 6) AS left_flank, round({_SECONDS('r')}, 6) AS right_flank FROM gap WHERE e > s OR u > t"""

QUERIES = {
    "seq_byte_align": (byte_align, f"WITH RECURSIVE {_ALIGN}"),
    "src_frames": (frame_inventory, f"WITH {_FRAMES}, x AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(a) AS x FROM v) GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(n) * 417 AS BIGINT) AS bytes, round(sum(n) * 1152 / 44100, 4) AS seconds, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated FROM x GROUP BY 1"),
}
