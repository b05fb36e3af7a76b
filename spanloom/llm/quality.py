"""Operator 9, quality rules: repetition counts, and the divergence of a document from its language.

Two scans and no shuffle of text. The first adds up, per language, a histogram of character classes
and one of common words over all documents (tasks send one row per language and bin). The second
holds each document's histograms against its language's, less the document's own counts, by the Jensen-Shannon distance.

Defined results: null or empty text has no words and fails the base rule; a null language is a
language of its own; a language with less than ``1 / SHARES`` of all words, or that is mostly the document
itself, is no reference: the histogram of all languages takes its place; repeated rows get one result each; an
empty table gives an empty one.
Only ``doc_id``, ``text`` and ``lang`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.store import materialize

# Frequent function words of the languages that the references cover.
COMMON_WORDS = (
    "the of and to in is that it for was on are as with be at this from by or an have not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par plus pas sur au avec "
    "el los las y del se por con para una no es lo al como su"
)

#: Languages with at least this part of all words have a reference of their own: there can be no more than ``SHARES``.
SHARES = 1000
#: Shorter documents are not judged by divergence.
MIN_WORDS, MIN_CHARS = 80, 400
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.30

CLASSES = ("space", "lower", "upper", "digit", "symbol", "punctuation", "latin", "other2", "wide", "astral")
_SKIP = len(CLASSES)


def _byte_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("punctuation"), np.int64)
    table[tx.SPACE] = CLASSES.index("space")
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[[ord(c) for c in "#*$%&|<>"]] = CLASSES.index("symbol")
    table[0x80:0xC0] = _SKIP  # continuation bytes: the character counts at its first byte
    table[0xC0:0xE0] = CLASSES.index("other2")
    table[[0xC3]] = CLASSES.index("latin")
    table[0xE0:0xF0], table[0xF0:] = CLASSES.index("wide"), CLASSES.index("astral")
    return table


_CLASS = _byte_classes()


def common_word_list() -> list[str]:
    return list(dict.fromkeys(COMMON_WORDS.split()))


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words, and the bin of each."""
    data, offsets = tx.doc_bytes(pa.array(common_word_list()))
    hashes = tx.words(data, offsets)[2]
    order = np.argsort(hashes)
    return hashes[order], order


N_CHAR, N_WORD = len(CLASSES), len(common_word_list()) + 1


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and histograms of each document of an Arrow column."""
    known, bins = _common_hashes()
    data, offsets = tx.doc_bytes(column)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    chars, common = np.zeros((n, N_CHAR), np.int64), np.zeros((n, N_WORD), np.int64)
    for i, j in tx.doc_slices(offsets):
        part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        _, _, hashes, bounds = tx.words(part, offs)
        counts = np.diff(bounds)
        out["n_words"][i:j] = counts
        doc_of_byte = np.repeat(np.arange(j - i), np.diff(offs))
        chars[i:j] = np.bincount(doc_of_byte * (_SKIP + 1) + _CLASS[part], minlength=(j - i) * (_SKIP + 1)).reshape(j - i, -1)[:, :N_CHAR]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        which = np.where(known[at] == hashes, bins[at], N_WORD - 1)
        doc_of_word = np.repeat(np.arange(j - i), counts)
        common[i:j] = np.bincount(doc_of_word * N_WORD + which, minlength=(j - i) * N_WORD).reshape(j - i, -1)
        out["n_repeat_words"][i:j] = _repeat_words(hashes, bounds, doc_of_word)
        raw = part.tobytes()
        for d in range(j - i):
            lines = raw[offs[d] : offs[d + 1]].split(b"\n")
            if len(lines) > 1:
                worded = [x for x in lines if x.strip(b" \t\r\x0b\x0c")]
                out["n_dup_lines"][i + d] = len(worded) - len(set(worded))
    out["word_chars"] = chars[:, 1:].sum(axis=1)
    out["n_symbols"] = chars[:, CLASSES.index("symbol")].copy()
    return out | {"chars": chars, "common": common}


def _repeat_words(hashes: np.ndarray, bounds: np.ndarray, doc_of_word: np.ndarray) -> np.ndarray:
    """Words that lie in three-word windows found twice or more in their document."""
    n_docs, n = len(bounds) - 1, len(hashes)
    if n < 4:
        return np.zeros(n_docs, np.int64)
    whole = doc_of_word[:-2] == doc_of_word[2:]
    window = (hashes[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
    key = tx.mix(window ^ tx.mix(doc_of_word[:-2].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return np.bincount(doc_of_word[covered], minlength=n_docs)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts from its row of the reference; 0 where either is empty."""
    a, b = counts.sum(axis=1, keepdims=True), reference.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(a, 1), reference / np.maximum(b, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where((a[:, 0] > 0) & (b[:, 0] > 0), np.sqrt(np.maximum(kl.sum(axis=1) / 2, 0)), 0.0)


def references(docs: DataFrame) -> dict:
    """Summed histograms over all documents: ``by_lang``, and ``pooled`` over all languages.

    Bounded: at most ``SHARES`` rows of about a hundred numbers come to the driver.
    """
    width = N_CHAR + N_WORD

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, k, int(v)) for lang, hist in sums.items() for k, v in enumerate(hist) if v]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "bin", "n"])

        for batch in batches:
            f = features(batch.column(0))
            hist = np.concatenate([f["chars"], f["common"]], axis=1)
            langs = batch.column(1).dictionary_encode()
            codes = langs.indices.fill_null(len(langs.dictionary)).to_numpy(zero_copy_only=False)
            for code in np.unique(codes):
                lang = langs.dictionary[int(code)].as_py() if code < len(langs.dictionary) else None
                total = hist[codes == code].sum(axis=0)
                sums[lang] = sums[lang] + total if lang in sums else total
            if len(sums) > SHARES:
                yield flush()
        yield flush()

    bins = docs.select("text", "lang").mapInArrow(partial, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    bins = materialize(bins, "bins")  # read twice: a few numbers for each language
    per_lang = bins.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("hist"), F.sum(F.when(F.col("bin") >= N_CHAR, F.col("n"))).alias("words"))
    pooled = np.zeros(width, np.int64)
    for b, n in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        pooled[b] = n
    found: dict[str | None, np.ndarray] = {}
    for row in per_lang.where(F.col("words") * SHARES >= int(pooled[N_CHAR:].sum())).collect():
        hist = np.zeros(width, np.int64)
        for b, n in row["hist"]:
            hist[b] = n
        found[row["lang"]] = hist
    return {"by_lang": found, "pooled": pooled}


def judge(column: pa.Array, langs: pa.Array, refs: dict) -> dict[str, np.ndarray]:
    """Counts, base rule, distances and verdict for a batch."""
    f = features(column)
    own = np.concatenate([f["chars"], f["common"]], axis=1)
    # the document's own words are among its language's
    ref = np.array([refs["by_lang"].get(x, refs["pooled"]) for x in langs.to_pylist()], np.int64).reshape(own.shape) - own
    few = ref[:, N_CHAR:].sum(axis=1) < f["n_words"]
    ref[few] = refs["pooled"] - own[few]
    f["char_distance"] = js_distance(own[:, :N_CHAR], ref[:, :N_CHAR])
    f["word_distance"] = js_distance(own[:, N_CHAR:], ref[:, N_CHAR:])
    f["base_failed"] = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    judged = (f["n_words"] >= MIN_WORDS) & (f["word_chars"] >= MIN_CHARS)
    far = (f["char_distance"] > MAX_CHAR_DISTANCE) | (f["word_distance"] > MAX_WORD_DISTANCE)
    f["kept"] = ~f["base_failed"] & ~(judged & far)
    return f


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, both distances, ``base_failed`` and ``kept``: one row per row of ``docs``."""
    refs = references(docs)
    types = dict.fromkeys(COLUMNS, "long") | {"char_distance": "double", "word_distance": "double", "base_failed": "boolean", "kept": "boolean"}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = judge(batch.column(1), batch.column(2), refs)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[c]) for c in COLUMNS)], names=["doc_id", *COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(score, "doc_id long, " + ", ".join(f"{c} {types[c]}" for c in COLUMNS))


def keeps(docs: DataFrame) -> Callable[..., Column]:
    """A column function ``(text, lang) -> kept`` with the references of ``docs``."""
    refs = references(docs)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.array(judge(text, lang, refs)["kept"])

    return kept
