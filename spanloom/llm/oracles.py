"""DuckDB SQL of the corpus queries that SQL can express; written for tables of some thousands of documents."""

from __future__ import annotations

from spanloom.llm import quality, secrets

_WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard(shingle: int = 3, percent: int = 90) -> str:
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(shingle))
    return f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= {shingle} THEN list_transform(range(1, len(w) - {shingle} + 2), lambda i: {run}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach AS (SELECT a, a AS z FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.z),
c AS (SELECT reach.a AS r, min(s.doc_id) AS least FROM reach JOIN s ON s.r = reach.z GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.least, s.doc_id) AS component_id FROM s LEFT JOIN c USING (r)"""


def _spans(kind: str, pattern: str, good: str, value: str = "m") -> str:
    """Matches of a pattern with their places: the stretches between them, and they themselves, are added up."""
    return f"""{kind}0 AS (SELECT r, regexp_split_to_array(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM d WHERE regexp_matches(text, '{pattern}')),
{kind} AS (SELECT r, {secrets.KINDS.index(kind)} AS rank, st AS s, st + length(m) AS e, {value} AS v FROM (SELECT r, m[i] AS m, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}0)) WHERE {good})"""


def ownership() -> str:
    assign = secrets.ASSIGN.replace("'", "''")
    many = lambda n, total: f"({n} >= 2 AND ({n} >= {secrets.WIDE} OR 2 * {n} >= {total}))"
    names = "['assign', 'access', 'hex', 'generic']"
    written = lambda c: f"array_to_string(list_transform(list_sort({c}), lambda x: {names}[x[2] + 1] || ':' || x[1] || ':' || x[3]), ',')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('o' || source, 'n') AS owner, coalesce('o' || source, 'n') || '/' || coalesce('o' || lang, 'n') AS repository FROM documents),
{_spans('assign', assign, 'length(v) >= 8', f"regexp_extract(m, '{assign}', 2)")}, {_spans('access', 'AKIA[A-Z0-9]{12,}', 'true')}, {_spans('hex', '[0-9a-f]{32,}', 'true')},
{_spans('generic', '[A-Za-z0-9+/_-]{24,}', "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')")},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
every AS (SELECT * FROM base UNION ALL SELECT * FROM generic g WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = g.r AND b.s < g.e AND b.e > g.s)),
known AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM every JOIN d USING (r) GROUP BY v),
total AS (SELECT count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM d),
judged AS (SELECT every.*, k.owners, k.repositories, NOT ({many('k.owners', 't.owners')} AND {many('k.repositories', 't.repositories')}) AS own FROM every JOIN known k ON k.v = every.v CROSS JOIN total t),
agg AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, list([s, rank, e]) FILTER (WHERE rank < 3) AS b, list([s, rank, e, owners, repositories]) FILTER (WHERE rank < 3 OR own) AS x, count(*) FILTER (WHERE rank < 3 AND own) AS n_owner_specific, count(*) FILTER (WHERE rank < 3 AND NOT own) AS n_copied FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce({written('b')}, '')) AS base_sha256, coalesce({written('x')}, '') AS spans, coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_copied, 0) AS n_copied,
coalesce(array_to_string(list_transform(list_sort(x), lambda y: y[4]), ','), '') AS n_owners, coalesce(array_to_string(list_transform(list_sort(x), lambda y: y[5]), ','), '') AS n_repositories FROM d LEFT JOIN agg USING (r)"""


def divergence() -> str:
    count = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))"
    space, symbol = "\\x20\\x09-\\x0D", "#*$%&|<>"
    rest = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() and c != 32 and not 9 <= c <= 13 and chr(c) not in symbol)
    classes = (space, "a-z", "A-Z", "0-9", symbol, rest, "\\x{C0}-\\x{FF}", "\\x{80}-\\x{BF}\\x{100}-\\x{7FF}", "\\x{800}-\\x{FFFF}", "\\x{10000}-\\x{10FFFF}")
    words = ", ".join(f"('{w}')" for w in quality.common_word_list())
    # of two histograms by bin, the square of the distance
    part = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
n AS (SELECT *, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, {count(symbol)} AS n_symbols, string_split(text, chr(10)) AS lines FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(lines) AS x FROM n) WHERE regexp_matches(x, '{_WORD}') GROUP BY r),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, n_words - 1)) AS i FROM n WHERE n_words >= 3)),
twice AS (SELECT r, x FROM win GROUP BY r, x HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM win JOIN twice USING (r, x), range(3) t(k) GROUP BY r),
f AS (SELECT n.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM n LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
ch AS ({" UNION ALL ".join(f"SELECT r, lang, 'c' AS side, '{i}' AS bin, {count(p)} AS c FROM f" for i, p in enumerate(classes))}),
common(word) AS (VALUES {words}),
wd AS (SELECT r, lang, 'w' AS side, coalesce(word, '') AS bin, count(*) AS c FROM (SELECT r, lang, unnest(w) AS x FROM f) LEFT JOIN common ON word = x GROUP BY ALL),
h AS (SELECT * FROM ch UNION ALL SELECT * FROM wd),
lh AS (SELECT lang, side, bin, sum(c) AS c FROM h GROUP BY ALL), ph AS (SELECT side, bin, sum(c) AS c FROM h GROUP BY ALL),
lw AS (SELECT lang, sum(c) AS words FROM lh WHERE side = 'w' GROUP BY 1), pw AS (SELECT sum(c) AS words FROM lh WHERE side = 'w'),
pick AS (SELECT f.*, lw.words IS NOT NULL AND lw.words * {quality.SHARES} >= pw.words AND lw.words - n_words >= n_words AS own_lang FROM f LEFT JOIN lw ON lw.lang IS NOT DISTINCT FROM f.lang CROSS JOIN pw),
bins AS (SELECT k.r, q.side, q.bin, coalesce(h.c, 0) AS a, q.c - coalesce(h.c, 0) AS b FROM pick k JOIN lh q ON k.own_lang AND q.lang IS NOT DISTINCT FROM k.lang LEFT JOIN h ON h.r = k.r AND h.side = q.side AND h.bin = q.bin
UNION ALL SELECT k.r, q.side, q.bin, coalesce(h.c, 0), q.c - coalesce(h.c, 0) FROM pick k JOIN ph q ON NOT k.own_lang LEFT JOIN h ON h.r = k.r AND h.side = q.side AND h.bin = q.bin),
sums AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY r, side), 0) AS p, b / nullif(sum(b) OVER (PARTITION BY r, side), 0) AS q FROM bins),
js AS (SELECT r, side, sqrt(greatest(sum({part('p', 'q')} + {part('q', 'p')}) / 2, 0)) AS d FROM sums WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY r, side),
v AS (SELECT f.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words >= {quality.MIN_WORDS} AND word_chars >= {quality.MIN_CHARS} AND (coalesce(c.d, 0) > {quality.MAX_CHAR_DISTANCE} OR coalesce(w.d, 0) > {quality.MAX_WORD_DISTANCE}) AS far FROM f LEFT JOIN js c ON c.r = f.r AND c.side = 'c' LEFT JOIN js w ON w.r = f.r AND w.side = 'w')
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v"""


def substrings(window: int = 13) -> str:
    """All windows as strings; a word goes if one over it starts in a document of a smaller id too."""
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM t WHERE len(w) >= {window})),
least AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN least USING (x), range({window}) s(k) WHERE m < doc_id),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS x FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.x, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)"""


def centroid_clusters(k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> str:
    """Each round compares every vector with every centroid, by component."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (SELECT x.r, m.c, sum((x.v - m.v) * (x.v - m.v)) AS d FROM x JOIN m{r} m USING (i) GROUP BY x.r, m.c)) WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT a.c, x.i, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} a USING (r) GROUP BY a.c, x.i),
m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, m.v) AS v FROM m{r} m LEFT JOIN s{r} s USING (c, i))""")
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
x AS MATERIALIZED (SELECT r, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, embedding, unnest(range(1, {width + 1})) AS i FROM e)),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS c FROM e QUALIFY c < {k}), m0 AS MATERIALIZED (SELECT f.c, x.i, x.v FROM f JOIN x USING (r)),
{", ".join(steps)}, h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256 FROM a{rounds} a JOIN e USING (r) JOIN h USING (c)"""


def periodic(scales: int = 14) -> str:
    """Runs by windows of 2 ** (k + 1) words: inside a run of period q <= 2 ** (k + 1) a window recurs first after q words exactly, and nowhere sooner.

    Written for texts of fewer than 2 ** (scales + 2) words.
    """
    step = "list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ord(substr(doc_id::VARCHAR, i, 1)), 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"
    parts = []
    for k in range(scales):
        prior = f"id{k}"
        parts.append(f"""id{k + 1} AS MATERIALIZED (SELECT r, i, n, hash(h, lead(h, {1 << k}) OVER (PARTITION BY r ORDER BY i)) AS h, i + {2 << k} <= n AS inside FROM {prior} WHERE n >= {4 << k}),
d{k} AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r, h ORDER BY i) AS q FROM id{k + 1} WHERE inside),
g{k} AS (SELECT r, q, min(i) - q AS s, max(i) + {2 << k} AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM d{k} WHERE q >= {1 << k} AND q < {2 << k}) GROUP BY r, q, g HAVING e - s >= greatest(6, 4 * q))""")
    runs = " UNION ALL ".join(f"SELECT r, s, e, q FROM g{k}" for k in range(scales))
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, xor(4294967295, {step}) AS crc FROM documents),
p AS (SELECT *, len(w) AS n, crc // 10 AS g FROM t), p2 AS (SELECT *, CASE WHEN crc % 10 = 0 AND n > 0 THEN g % n END AS a FROM p), p3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p2),
u AS (SELECT r, doc_id, n, w, a, p, unnest(range(n)) AS i FROM p3), u2 AS MATERIALIZED (SELECT r, i, n, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM u),
id0 AS (SELECT r, i, n, hash(word) AS h FROM u2), {", ".join(parts)},
runs AS MATERIALIZED (SELECT r, CAST(s AS BIGINT) AS start, CAST(e - s AS BIGINT) AS length, CAST(q AS BIGINT) AS period FROM ({runs})),
best AS (SELECT r, start, length, period, 1000 * length // period AS exponent_milli FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS x FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS x FROM u2 ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines.x, '')) AS runs_sha256, sha256(coalesce(kept.x, '')) AS collapsed_sha256
FROM t LEFT JOIN lines USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": jaccard(), "op8_secret_ownership": ownership(), "op9_quality_divergence": divergence(), "op11_substring_dedup": substrings(), "op12_centroid_clusters": centroid_clusters(), "op13_periodic_runs": periodic()}
