"""Operator 6, personal data: fixed formats, and identifiers that bootstrapped contexts discover.

Seeds are the matches of four formats (email, ip, card, phone). Each seed, and each other token that
looks like an identifier, is an instance; the words around it are its patterns (two to the left; one
to each side; one to the left with the token's shape). Spark holds the graph of patterns and distinct
instances and scores it in rounds: a pattern's score for a kind is the mean score of its instances, an
instance's score the mean of those of all its patterns times ``DAMPING`` (seeds stay at 1 for their kind and 0
for others). Patterns with ``MIN_SEEDS`` distinct seeds of a kind and a score of ``MIN_SCORE`` are of high
confidence; all of them are the model. Instances in a pattern of the model become seeds of its kind for the
next round. Rounds end when no pattern was added and none can be: damped scores change by at most ``DAMPING``
times the last change, so all that is still to come is bounded, and less than ``CLOSE`` counts as nothing.
The identifier-like tokens that stand in a pattern of the model are added, with the kind of the best such
pattern. Base spans always stay.

One scan writes every row's instances with their places and patterns. The edges are summed by (pattern,
instance) before they are joined, so a frequent pattern or instance sends one row for each distinct pair.
The model is a written table of any size, to which the candidates' patterns are joined; the spans found are
collected by row (``find_pii``) or by the text's digest (``redact``).

Defined results: null or empty text has no spans; repeated rows get one row each; ids may be null; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.store import materialize

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_SCORE, DAMPING, CLOSE = 5, 0.8, 0.7, 0.001
CONTEXT = 80  # characters on either side in which context words are looked for

# The formats.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can begin nowhere else than where digits begin
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_SPACES = frozenset(" \t\n\r\x0b\x0c")
_MARKED = re.compile("[0-9@]")
_WORD_REST = re.compile(r"[^\x20\x09-\x0D]*")
_OPENING, _CLOSING = "([{<\"'", ".,;:!?)]}>\"'"

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the formats, by kind as listed, then start."""
    out = list(_emails(text)) if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens with an at sign or four digits that no base span touches."""
    taken = sorted((s, e) for _, s, e in base)
    done, k = 0, 0
    hit = _MARKED.search(text)
    while hit:
        start = hit.start()
        while start > done and text[start - 1] not in _SPACES:
            start -= 1
        end = done = _WORD_REST.match(text, hit.start()).end()
        while start < end and text[start] in _OPENING:
            start += 1
        while end > start and text[end - 1] in _CLOSING:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= 6 and not (k < len(taken) and taken[k][0] < end):
            token = text[start:end]
            if "@" in token or sum(c.isdigit() for c in token) >= 4:
                yield start, end
        hit = _MARKED.search(text, done)


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in token))


def patterns_of(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a token."""
    left = text[max(0, start - CONTEXT) : start].lower().split()[-2:]
    right = text[end : end + CONTEXT].lower().split()[:1]
    left, right = [""] * (2 - len(left)) + left, right or [""]
    found = (f"2 {left[0]} {left[1]}", f"1 {left[1]} {right[0]}", f"s {left[1]} {_shape(text[start:end])}")
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in found]


_PLACES = "array<struct<kind:string,start:bigint,end:bigint,instance:bigint,patterns:array<bigint>>>"
_PLACES_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def _scan(docs: DataFrame, key: Column, key_type: str) -> DataFrame:
    """key, places: base spans by kind and start, then candidates, whose kind is null."""

    def places(text: str | None) -> list[dict]:
        if not text or not _MARKED.search(text):
            return []
        base = base_spans(text)
        found = [*base, *((None, *x) for x in candidates(text, base))]
        return [{"kind": k, "start": s, "end": e, "instance": xxhash.xxh64_intdigest(text[s:e].lower()) - (1 << 63), "patterns": patterns_of(text, s, e)} for k, s, e in found]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([places(x) for x in batch.column(1).to_pylist()], _PLACES_ARROW)], names=["key", "places"])

    return docs.select(key.alias("key"), "text").mapInArrow(scan, f"key {key_type}, places {_PLACES}")


def learn_patterns(scanned: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """The model as a written table: pattern, kind, score."""
    each = scanned.select(F.explode("places").alias("x")).select(F.explode("x.patterns").alias("pattern"), "x.instance", "x.kind")
    pairs = materialize(each.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    edges = pairs.join(pairs.groupBy("pattern").agg(F.count("*").alias("n")), "pattern")
    # patterns of a single instance only hand it back its own damped score: they count in its divisor
    known = edges.groupBy("instance").agg(F.max("kind").alias("kind"), (F.count("*") - DAMPING * F.sum((F.col("n") == 1).cast("long"))).alias("divisor"))
    graph = materialize(edges.where("n > 1").select("pattern", "instance", "n").join(known, "instance"), "graph")
    fixed = materialize(graph.groupBy("pattern", "n").agg(*(F.sum((F.coalesce("kind", F.lit("")) == k).cast("long")).alias(f"f_{k}") for k in KINDS)), "fixed")
    free = materialize(graph.where("kind IS NULL").select("pattern", "instance", "divisor"), "free")
    patterns = states = None
    while True:
        now = fixed
        if states is not None:
            value = lambda k: F.when(F.col("promoted").isNotNull(), (F.col("promoted") == k).cast("double")).otherwise(DAMPING * F.col(f"u_{k}"))
            sums = free.select("pattern", "instance").join(states, "instance").groupBy("pattern").agg(*(F.sum((F.coalesce("promoted", F.lit("")) == k).cast("long")).alias(f"a_{k}") for k in KINDS), *(F.sum(value(k)).alias(f"v_{k}") for k in KINDS))
            now = fixed.join(sums, "pattern", "left").join(patterns.select("pattern", F.col("kind").alias("was"), *(F.col(f"p_{k}").alias(f"o_{k}") for k in KINDS)), "pattern")
        else:
            now = now.select("*", F.lit(None).cast("string").alias("was"), *(F.lit(0).alias(f"a_{k}") for k in KINDS), *(F.lit(0.0).alias(f"{c}_{k}") for c in "vo" for k in KINDS))
        score = {k: F.round((F.col(f"f_{k}") + F.coalesce(f"v_{k}", F.lit(0.0))) / F.col("n"), 9) for k in KINDS}
        now = now.select("pattern", "was", *(score[k].alias(f"p_{k}") for k in KINDS), *((F.col(f"f_{k}") + F.coalesce(f"a_{k}", F.lit(0)) >= min_seeds).alias(f"e_{k}") for k in KINDS), F.greatest(*(F.abs(score[k] - F.col(f"o_{k}")) for k in KINDS)).alias("change"))
        best = F.array_max(F.array(*(F.struct(F.when(F.col(f"e_{k}"), F.col(f"p_{k}")).otherwise(-1.0).alias("score"), F.lit(k).alias("kind")) for k in KINDS)))
        now = now.select("*", best.alias("best")).withColumn("kind", F.coalesce("was", F.when(F.col("best.score") >= min_score, F.col("best.kind"))))
        patterns = materialize(now, "patterns")
        new, change = F.col("was").isNull() & F.col("kind").isNotNull(), patterns.agg(F.max("change")).first()[0] or 0.0
        to_come = change * DAMPING / (1 - DAMPING)
        added, near = patterns.agg(F.count(F.when(new, 1)), F.count(F.when(F.col("kind").isNull() & (F.col("best.score") + to_come >= min_score), 1))).first()
        if states is not None and not added and (not near or to_come < CLOSE):
            break
        found = F.max(F.when(F.col("kind").isNotNull(), F.struct(_score(), F.col("kind"))))["kind"]
        scores = free.join(patterns, "pattern").groupBy("instance").agg(found.alias("found"), *((F.sum(f"p_{k}") / F.first("divisor")).alias(f"u_{k}") for k in KINDS))
        if states is not None:  # a seed keeps its first kind
            scores = scores.join(states.select("instance", "promoted"), "instance").withColumn("found", F.coalesce("promoted", "found")).drop("promoted")
        states = materialize(scores.withColumnRenamed("found", "promoted"), "states")
    return materialize(patterns.where("kind IS NOT NULL").select("pattern", "kind", _score()), "model")


def _score() -> Column:
    """The score for the kind that a pattern has."""
    return F.coalesce(*(F.when(F.col("kind") == k, F.col(f"p_{k}")) for k in KINDS)).alias("score")


def _added(scanned: DataFrame, by: str, model: DataFrame) -> DataFrame:
    """The candidates that stand in a pattern of the model, collected by a column: by, added."""
    each = scanned.select(by, F.explode(F.filter("places", lambda x: x["kind"].isNull())).alias("x")).select(by, "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    best = each.join(model, "pattern").groupBy(by, "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
    return best.groupBy(by).agg(F.collect_list(_span(F.col("best.kind"), F.col("start"), F.col("end"))).alias("added"))


def _span(kind: Column, start: Column, end: Column) -> Column:
    return F.struct(F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("rank"), start.alias("start"), end.alias("end"), kind.alias("kind"))


def _base() -> Column:
    return F.transform(F.filter("places", lambda x: x["kind"].isNotNull()), lambda x: _span(x["kind"], x["start"], x["end"]))


def _every() -> Column:
    return F.array_sort(F.concat("base", F.coalesce("added", F.filter("base", lambda x: F.lit(False)))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all, as kind:start:end)."""
    scanned = materialize(_scan(docs, F.col("doc_id").cast("long"), "long").withColumn("row", F.monotonically_increasing_id()), "places")
    found = scanned.select("row", "key", _base().alias("base")).join(_added(scanned, "row", learn_patterns(scanned, **limits)), "row", "left")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("key").alias("doc_id"), *map(count, KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(_every()).alias("spans"))


def _redacted(text: str | None, spans: list[Span]) -> str | None:
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with ``[KIND]`` in place of every span.

    Base spans are found again in each text; only what the model adds is joined, by the text's digest (equal texts have
    equal spans), so that texts are not moved for it while it is small.
    """
    scanned = materialize(_scan(docs, F.sha2("text", 256), "string").where(F.size("places") > 0), "places")
    once = scanned.dropDuplicates(["key"])
    added = _added(once, "key", learn_patterns(scanned, **limits))
    spans = materialize(added.select(F.col("key").alias("_key"), _written(F.col("added")).alias("_spans")), "spans")

    @F.arrow_udf("string")
    def clean(text: pa.Array, written: pa.Array) -> pa.Array:
        read = lambda x: [(k, int(s), int(e)) for k, s, e in (y.split(":") for y in x.split(","))] if x else []
        return pa.array([_redacted(t, [*base_spans(t), *read(x)]) if t else t for t, x in zip(text.to_pylist(), written.to_pylist(), strict=True)], pa.string())

    joined = docs.join(spans, F.sha2(docs["text"], 256) == spans["_key"], "left")
    return joined.select(*(clean(docs["text"], "_spans").alias("text") if c == "text" else docs[c] for c in docs.columns))


def redactor(docs: DataFrame, **limits: float) -> Callable[[str], Column]:
    """As ``redact``, as a column function: it holds the whole model of ``docs`` in memory, so it is for models that fit there."""
    model = {r["pattern"]: (r["score"], r["kind"]) for r in learn_patterns(materialize(_scan(docs, F.lit(0), "int"), "places"), **limits).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(text: str | None) -> list[Span]:
        base = base_spans(text) if text else []
        known = ((x, [shared.value[p] for p in patterns_of(text, *x) if p in shared.value]) for x in (candidates(text, base) if text else ()))
        return [*base, *((max(found)[1], *x) for x, found in known if found)]

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([_redacted(x, spans(x)) for x in text.to_pylist()], pa.string())

    return clean
