"""Operator 7, byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation without regular expressions. Every character gets a class from a code-point table,
refined by what follows it (is white space followed by a visible character; does an apostrophe begin a
contraction). A class is a transition function on the eight states of the splitter, and functions compose
associatively: the text is laid out as rows of a matrix, each row's functions are composed column by
column for all rows at once, the rows' totals are scanned by doubling, and a last sweep gives the state
ahead of each character, whence the boundaries. The slices between boundaries go through a cache of
pair merges; ids and the byte offsets of each token are kept, and decoding fills the offsets' places.

Defined results: null and empty text has no ids and decodes to no bytes; repeated rows get one row
each; ids may be null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.token_counts import resolve

SLICE_BYTES = 1 << 20
MAX_KEPT = 300_000

# Character classes: letter, number, other, apostrophe ahead of one or two contraction letters, and white
# space that goes on, that ends and is a blank, that ends and is not.
LETTER, NUMBER, OTHER, SHORT, LONG, WHITE, LAST_BLANK, LAST_WHITE = range(8)
# States: nothing open, in letters, in numbers, in others, in white space, after a blank that the next
# character joins, one or two contraction letters to come.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOIN, ONE_MORE, TWO_MORE = range(8)
# Unicode's White_Space.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a token begins, by [class, state]."""
    after, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for kind, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        after[kind] = state
        begins[kind, [state, JOIN]] = False
    after[LETTER, TWO_MORE], after[LETTER, ONE_MORE] = ONE_MORE, NONE
    begins[LETTER, [ONE_MORE, TWO_MORE]] = False
    for kind, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # an apostrophe inside others or behind a blank is just another
        after[kind] = state
        after[kind, [IN_OTHERS, JOIN]] = IN_OTHERS
        begins[kind, [IN_OTHERS, JOIN]] = False
    after[WHITE], after[LAST_BLANK], after[LAST_WHITE] = IN_WHITE, JOIN, NONE
    begins[WHITE, IN_WHITE] = False
    return after, begins


AFTER, BEGINS = _automaton()


@functools.cache
def _code_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(code))[0]
        if major in "LN":
            table[code] = LETTER if major == "L" else NUMBER
    table[list(WHITE_SPACE)] = WHITE
    return table


def boundaries(codes: np.ndarray, first: np.ndarray, columns: int = 256) -> np.ndarray:
    """True where a token begins; ``first``: where documents begin (sorted positions)."""
    n = len(codes)
    if not n:
        return np.zeros(0, bool)
    kind = _code_classes()[codes]
    opens = np.zeros(n + 1, bool)
    opens[first[first < n]] = True
    opens[n] = True
    white = kind == WHITE
    ends = white.copy()  # white space ahead of a visible character of the same document
    ends[:-1] &= ~white[1:] & ~opens[1:-1]
    ends[-1] = False
    kind[ends] = np.where(codes[ends] == 32, LAST_BLANK, LAST_WHITE)
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        one = np.full(n + 3, 0, np.uint32)
        one[:n] = codes
        inside = lambda k: ~opens[np.minimum(quotes + k, n)]
        a, b = one[quotes + 1], one[quotes + 2]
        short = np.isin(a, [ord(c) for c in "stmd"]) & inside(1)
        pair = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        long = pair & inside(1) & inside(2)
        kind[quotes[short]] = SHORT
        kind[quotes[long]] = LONG
    # functions by class; a document's first character starts from nothing, so its function is constant
    table = np.concatenate([AFTER, np.repeat(AFTER[:, NONE : NONE + 1], 8, axis=1)])
    kind[opens[:n]] += 8
    rows = -(-n // columns)
    padded = np.zeros(rows * columns, np.uint8)
    padded[:n] = kind
    grid = np.ascontiguousarray(padded.reshape(rows, columns).T)
    flat = table.reshape(-1)
    total = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        total = flat[(column.astype(np.int16) * 8)[:, None] + total]
    step = 1
    while step < rows:  # composition of all rows up to each, by doubling
        total[step:] = np.take_along_axis(total[step:], total[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = total[:-1, NONE]
    ahead = np.empty((columns, rows), np.uint8)
    for k, column in enumerate(grid):
        ahead[k] = state
        state = flat[column.astype(np.int16) * 8 + state]
    before = np.ascontiguousarray(ahead.T).reshape(-1)[:n]
    return opens[:n] | BEGINS[kind & 7, before]


class Merger(dict):
    """Ids of a slice's bytes by pair merges of least rank; kept up to MAX_KEPT slices."""

    def __init__(self, vocabulary: str):
        super().__init__()
        with open(resolve(vocabulary), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        ids = (self.ranks[raw],) if raw in self.ranks else tuple(self.merge_short(raw) if len(raw) <= 64 else self.merge(raw))
        if len(raw) <= 256:
            self[piece] = ids
        return ids

    def merge_short(self, raw: bytes) -> list[int]:
        """As ``merge``, with a search for the least rank: quicker for a few bytes."""
        rank, none = self.ranks.get, len(self.ranks)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[x] for x in parts]

    def merge(self, raw: bytes) -> list[int]:
        """Linked list of parts, and a heap of the pairs that are tokens: least rank, then leftmost."""
        n = len(raw)
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < n and (rank := self.ranks.get(raw[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, end[b]))

        for a in range(n - 1):
            offer(a)
        live = [True] * n
        while heap:
            _, a, stop = heapq.heappop(heap)
            if not live[a] or nxt[a] >= n or end[nxt[a]] != stop:
                continue
            b = nxt[a]
            live[b], end[a], nxt[a] = False, end[b], nxt[b]
            if nxt[a] < n:
                prev[nxt[a]] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        return [self.ranks[raw[a : end[a]]] for a in range(n) if live[a]]


@functools.cache
def worker_merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


def encode_slice(texts: list[str], merger: Merger) -> list[list[int]]:
    """Ids of each text."""
    if len(merger) > MAX_KEPT:
        merger.clear()
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=first[1:])
    starts = np.flatnonzero(boundaries(codes, first[:-1][np.diff(first) > 0]))
    cuts = [*starts.tolist(), len(joined)]
    ids = [merger[joined[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    of_doc = np.searchsorted(starts, first, "left").tolist()
    return [list(chain.from_iterable(ids[a:b])) for a, b in zip(of_doc, of_doc[1:], strict=False)]


def token_offsets(ids: list[int], merger: Merger) -> np.ndarray:
    """Byte offsets of the tokens in the decoded text, and its length."""
    out = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(merger.bytes_of[i]) for i in ids], out=out[1:])
    return out


def decode(ids: list[int], merger: Merger) -> bytes:
    return b"".join(map(merger.bytes_of.__getitem__, ids))


def byte_bpe(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids and their byte offsets."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "offsets"] * keep_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merger = worker_merger(vocabulary)
            written = {i: str(i) for i in merger.bytes_of}
            _, offsets = tx.doc_bytes(batch.column(1))
            for i, j in tx.doc_slices(offsets, SLICE_BYTES):
                found = encode_slice([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()], merger)
                columns = [batch.column(0).slice(i, j - i), pa.array([len(x) for x in found], pa.int64())]
                columns.append(pa.array([hashlib.sha256(" ".join(map(written.__getitem__, x)).encode()).hexdigest() for x in found], pa.string()))
                columns.append(pa.array([hashlib.sha256(decode(x, merger)).hexdigest() for x in found], pa.string()))
                if keep_ids:
                    columns += [pa.array(found, pa.list_(pa.int32())), pa.array([token_offsets(x, merger) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<long>" * keep_ids)
