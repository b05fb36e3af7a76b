"""Column functions over text, markup and addresses; all but the quality of speech run in the JVM."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-part public suffixes.
TWO_PART = ("co.uk", "co.jp", "co.kr", "co.nz", "co.za", "co.in", "com.au", "com.br", "com.cn", "com.mx", "com.tw", "org.uk", "net.au", "ac.uk", "gov.uk")
# Parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "twclid", "ref", "source", "affiliate", "aff", "clickid", "irclickid")
# Path segments that keep their names.
PATH_WORDS = ("podcast", "podcasts", "offer", "offers", "promo", "code", "deal", "deals", "try", "start", "go", "special", "partner", "ref", "show", "radio")
# Named entities, the ampersand last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&#x27;", "'"), ("&#x2F;", "/"),
    ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&hellip;", "\u2026"), ("&amp;", "&"),
)
# Words that carry nothing.
FILLERS = ("um", "uh", "like", "so", "well", "basically", "actually", "literally", "right", "okay")
# Phrases of promotion by family, on text in lower case without punctuation, and each family's weight.
PHRASES = {
    "sponsor": (1.0, ("brought to you by", "sponsored by", "today s sponsor", "thanks to our sponsor", "this episode is sponsored", "this podcast is brought", "a word from our sponsor", "message from our sponsor", "supported by")),
    "promoCode": (1.2, ("use code [a-z0-9_]+", "promo code [a-z0-9_]+", "discount code [a-z0-9_]+", "coupon code [a-z0-9_]+", "code [a-z0-9_]+ at checkout", "enter code [a-z0-9_]+")),
    "urlCTA": (0.8, ("[a-z0-9_]+ com slash [a-z0-9_]+", "dot com slash [a-z0-9_]+", "check out [a-z0-9_]+", "head to [a-z0-9_]+", "go to [a-z0-9_]+ com", "visit [a-z0-9_]+ com", "head over to", "[a-z0-9_]+ dot com", "click the link", "link in the description", "link in the show notes")),
    "purchaseLanguage": (0.9, ("free trial", "money back guarantee", "first month free", "[0-9]+ percent off", "satisfaction guarantee", "risk free", "sign up today", "sign up now", "limited time offer", "exclusive offer", "special offer")),
    "transitionMarker": (0.3, ("let s get back to", "and now back to", "back to the show", "back to the episode", "anyway\\b", "without further ado", "moving on")),
}
# The addresses that count as strong, on the raw text.
STRONG_URL, STRONG_WEIGHT = "\\b[a-z0-9][a-z0-9-]*(?:[.][a-z0-9][a-z0-9-]*)*[.](?:com|net|org|io|co|app|fm|tv)\\b", 0.95
# What an address in a text looks like.
ADDRESS = "(?i)(?:https?://)?(?:www[.])?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?[.])+(?:com|net|org|io|co|app|fm|tv|me|info|biz|us|uk|ca|de|fr|es|it|nl|au|dev|tech|store|shop|edu|gov|mil|xyz|link|ly|gg)(?:/[^\\s<>\"')\\]]*)?"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def decode_entities(text: Column) -> Column:
    """Named entities, then decimal, then hexadecimal ones. What names no character stays."""
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    for pattern, lead, base in (("&#([0-9]+);", "&#", 10), ("&#x([0-9a-fA-F]+);", "&#x", 16)):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        text = F.when(text.contains("&#"), F.aggregate(found, text, _put_character(lead, base))).otherwise(text)
    return text


def _put_character(lead: str, base: int):
    def put(out: Column, digits: Column) -> Column:
        code = F.conv(digits, base, 10).try_cast("long")
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (F.length(digits) <= 7)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(32)), 8, "0")), "UTF-32")
        return F.when(real, F.replace(out, F.concat(F.lit(lead), digits, F.lit(";")), character)).otherwise(out)

    return put


def strip_html(html: Column) -> Column:
    """Tags as spaces, entities decoded, white space collapsed."""
    return collapse(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))


def with_scheme(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(with_scheme(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def domain(url: Column) -> Column:
    """The registrable domain: two labels, or three behind a two-part suffix; null for numbers and single labels."""
    labels = F.split(host(url), "\\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)))
    named = ~host(url).rlike("^[0-9.]*$") & (F.size(labels) >= 2)
    return F.when(named, F.when((F.size(labels) >= 3) & last(2).isin(*TWO_PART), last(3)).otherwise(last(2)))


def domains_in(text: Column) -> Column:
    """The distinct registrable domains of the addresses in a text, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), lambda u: domain(F.regexp_replace(u, "(?i)^((https?://)?)www[.]", "$1")))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


def canonical_url(url: Column) -> Column:
    """Host in lower case; no tracking parameters, default port or slash at the end of the path. An address without a scheme stays so."""
    whole = with_scheme(url)
    scheme = F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    user = F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?", 1)
    port = F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+(:[0-9]+)", 1)
    path = F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    query, fragment = F.regexp_extract(whole, "^[^?#]*[?]([^#]*)", 1), F.regexp_extract(whole, "(#.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")
    cut = F.when((F.length(path) > 1) & path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    out = F.concat(user, host(url), F.when(port.isin(":80", ":443"), "").otherwise(port), cut, tail, fragment)
    return F.when(F.lower(url).rlike("^https?://"), F.concat(scheme, F.lit("://"), out)).otherwise(out)


def path_shape(url: Column) -> Column:
    """The path with all but well-known segments as stars."""
    path = F.regexp_extract(with_scheme(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.concat_ws("/", F.transform(parts, lambda s: F.when(F.lower(s).isin(*PATH_WORDS), F.lower(s)).otherwise("*"))))


def redact(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Each pattern's matches as its placeholder, in order."""
    for pattern, placeholder in patterns:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def char_ngrams(text: Column, n: int) -> Column:
    """The distinct n-character pieces; a shorter text is its own."""
    last = F.greatest(F.length(text) - n + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.size(F.array_union(a, b))


def dot(a: Column, b: Column) -> Column:
    """Inner product; the shorter vector is padded with zeros."""
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: number(x) * number(y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors padded with zeros, nothing below 0; 0 for a vector without length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), dot(a, b) / size)).otherwise(0.0)


def canberra_similarity(a: Column, b: Column) -> Column:
    """exp(-4 * mean(|a - b| / (a + b + 1e-6))) of non-negative vectors."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y) / (x + y + F.lit(1e-6)))
    return F.exp(-4 * F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))


def plain_words(text: Column) -> Column:
    """Lower case, letters, digits and white space only, without fillers: the words in order."""
    kept = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]", "")
    return F.filter(F.split(kept, "\\s+"), lambda w: (w != "") & ~w.isin(*FILLERS))


def spoken(text: Column) -> Column:
    """Lower case with everything but letters and digits as single spaces: what the phrases are matched on."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def phrase_counts(text: Column, families: dict[str, tuple[float, tuple[str, ...]]]) -> dict[str, Column]:
    """Matches of each family's patterns, each pattern by itself."""
    out = {}
    for family, (_, patterns) in families.items():
        total = F.lit(0).cast("long")
        for p in patterns:
            total = total + F.regexp_count(text, F.lit(p)).cast("long")
        out[family] = total
    return out


def interpolated(start: Column, end: Column, position: Column, length: Column) -> Column:
    """The time of a place in a text that runs from start to end."""
    return F.when(length > 0, start + (end - start) * (position / length)).otherwise(start)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: ``inline`` of one struct, unlike a projection, is not merged into later uses."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def speech_quality(rows: DataFrame, text: str, seconds: Column) -> DataFrame:
    """``rows`` with the parts of a transcript's quality (0 to 1): punctuation, density, repetition, word_length; null for a null text.

    One pass in Arrow batches, a stretch of texts at a time: words get numbers once a stretch, so that what a word is like is worked out for distinct words only.
    """

    @F.arrow_udf("struct<punctuation:double,density:double,repetition:double,word_length:double>")
    def parts(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        return _speech_parts(texts, lengths)

    return once(rows, _q=parts(F.col(text), seconds.cast("double"))).select(*rows.columns, "_q.*")


_WORDS = re.compile("[^ \\t\\n\\x0b\\f\\r]+")


#: Bytes of the texts that are held as words at once; a longer text alone.
_STRETCH = 1 << 20


def _speech_parts(texts: pa.Array, lengths: pa.Array) -> pa.Array:
    """The parts for a batch: it may hold thousands of long texts, so its words are never held together."""
    kind = pa.struct([(n, pa.float64()) for n in ("punctuation", "density", "repetition", "word_length")])
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, []
    while first < len(texts):
        before = int(sizes[first - 1]) if first else 0
        until = max(first + 1, int(np.searchsorted(sizes, before + _STRETCH, "right")))
        done.append(pa.array(_stretch_parts(texts[first:until].to_pylist(), lengths[first:until].to_pylist()), kind))
        first = until
    return pa.concat_arrays(done) if done else pa.array([], kind)


def _stretch_parts(texts: list[str | None], lengths: list[float | None]) -> list[dict | None]:
    known: dict[str, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)) for found in (_WORDS.findall(t) if t is not None else [] for t in texts)]
    lower: dict[str, int] = {}
    low = np.fromiter((lower.setdefault(w.lower(), len(lower)) for w in known), np.int64, len(known))
    size = np.fromiter(map(len, known), np.int64, len(known))
    odd = np.fromiter(map(_unusual, lower), float, len(lower))
    return [None if t is None else _speech(t, low[i], size[i], odd, len(lower), s) for t, i, s in zip(texts, ids, lengths, strict=True)]


def _speech(text: str, words: np.ndarray, size: np.ndarray, odd: np.ndarray, known: int, seconds: float | None) -> dict:
    """The parts for a text's words (numbers in lower case, lengths); ``odd`` has each number's penalty."""
    clamp = lambda x: max(0.0, min(1.0, float(x)))
    n, rate = len(words), len(words) / seconds if seconds and seconds > 0 else 0.0
    density = next((v for v, (a, b) in ((1.0, (1.5, 4.0)), (0.6, (1.0, 5.0)), (0.3, (0.5, 6.0))) if a <= rate <= b), 0.0)
    punctuation = length = 0.5
    if n >= 5:
        enders = sum(map(text.count, ".!?"))
        punctuation = clamp(1 - abs(enders / max(1.0, n / 20) - 1) * 0.5)
        mean, square = size.sum() / n, (size * size).sum() / n
        deviation = math.sqrt(max(0.0, square - mean * mean))
        by_mean = 1.0 if 3.0 <= mean <= 7.0 else max(0.0, 1 - abs(mean - 5) * 0.2)
        by_deviation = 1.0 if 1.5 <= deviation <= 4.0 else deviation / 1.5 if deviation < 1.5 else max(0.0, 1 - (deviation - 4) * 0.2)
        length = clamp((by_mean + by_deviation) / 2 * (1 - odd[words].sum() / n))
    repetition = 0.8
    if n >= 10:
        counts = np.unique(words[:-1] * known + words[1:], return_counts=True)[1]
        repetition = max(0.0, 1 - int(counts[counts > 2].sum()) / (n - 1) * 3)
    return {"punctuation": punctuation, "density": density, "repetition": repetition, "word_length": length}


def _unusual(w: str) -> float:
    """Penalty of a word in lower case for what words seldom are, 1 at most."""
    kinds = [unicodedata.category(c)[0] for c in w]
    letters, digits = kinds.count("L"), kinds.count("N")
    total = 0.4 * (letters == 0) + 0.2 * (digits > 0 and letters > 0) + 0.3 * (len(w) > 18) + 0.3 * bool(_FOUR.search(w)) + 0.2 * (letters >= 5 and sum(map(w.count, "aeiouy")) / letters < 0.15)
    return min(1.0, total)


_FOUR = re.compile("(.)\\1\\1\\1")


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.65, "good").when(score >= 0.35, "degraded").otherwise("unusable")


def role_flags(rows: DataFrame, text: str, roles: dict[str, str]) -> DataFrame:
    """``rows`` with ``found``: the first sentence of each role that the text has, as an array of (role, at)."""
    rows = once(rows, _s=F.filter(F.split(F.lower(text), "[.!?]+"), lambda s: F.trim(s) != ""))
    first = lambda p: F.array_min(F.filter(F.transform("_s", lambda s, i: F.when(s.rlike(p), i)), lambda i: i.isNotNull()))
    return once(rows, found=F.filter(F.array(*(F.struct(F.lit(r).alias("role"), first(p).alias("at")) for r, p in roles.items())), lambda x: x["at"].isNotNull())).drop("_s")


def order_consistency(found: str) -> Column:
    """Share of the pairs of roles, in their expected order, whose sentences are in that order too."""
    pairs = F.flatten(F.transform(found, lambda a, i: F.transform(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda b: (a["at"] <= b["at"]).cast("double"))))
    return F.when(F.size(found) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(1.0)


def redact_related(text: Column, triggers: Sequence[tuple[str, str]], related: Sequence[tuple[str, str]]) -> Column:
    """Triggers' matches as placeholders; the related patterns' too, but only in a text that has a trigger."""
    has = F.lit(False)
    for pattern, _ in triggers:
        has = has | text.rlike(pattern)
    clean = redact(text, triggers)
    return F.when(has, redact(clean, related)).otherwise(clean)


def numbered(rows: DataFrame, text: str, pattern: str, name: str, out: str) -> DataFrame:
    """``out``: each distinct match, in lower case, as ``[NAME_A]``, ``[NAME_B]``, ... by its first place; the same value has the same letter."""
    rows = once(rows, _m=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = once(rows, _d=F.array_distinct(F.transform("_m", F.lower)), _p=F.split(text, pattern))
    letter = lambda i: F.concat(F.when(i >= 26, F.char((F.lit(64) + F.floor(i / 26)).cast("int"))).otherwise(""), F.char((F.lit(65) + F.pmod(i, F.lit(26))).cast("int")))
    put = lambda m: F.when(m.isNull(), "").otherwise(F.concat(F.lit(f"[{name}_"), letter(F.array_position("_d", F.lower(m)) - 1), F.lit("]")))
    joined = F.array_join(F.flatten(F.zip_with("_p", "_m", lambda p, m: F.array(p, put(m)))), "")
    return rows.withColumn(out, F.when(F.size("_m") > 0, joined).otherwise(F.col(text))).drop("_m", "_d", "_p")


def first_host(hosts: Column, networks: Sequence[tuple[str, str]]) -> Column:
    """The network of the first pattern, in order of precedence, that any host holds; ``unknown`` otherwise."""
    out = F.when(F.lit(False), "")
    for pattern, network in networks:
        out = out.when(F.exists(hosts, lambda h: F.lower(h).contains(pattern)), network)  # noqa: B023
    return out.otherwise("unknown")


def spoken_domain(name: Column) -> Column:
    """How a domain is said: its labels with ``dot`` between them."""
    return F.replace(name, F.lit("."), F.lit(" dot "))
