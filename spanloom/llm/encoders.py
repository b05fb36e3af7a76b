"""Whole texts through the tokenizers library, each distinct stretch of text encoded once per worker.

A text is cut where the tokenizer's own pre-tokenisation cuts whatever stands on either side: ahead
of white space that follows a visible character, and behind a run of letters when white space or
plain punctuation follows. The stretches' ids, joined, are then the ids of the whole text. A text that
may hold one of the tokenizer's added tokens, which it finds in texts ahead of all else, is encoded whole.

New stretches go through the library many at once. Where the tokenizer takes bytes as they are, those that begin with white
space and end with a visible character follow each other with nothing between, as these are such cuts again, and the lengths
of the ids' bytes tell where each ends; others have a special token between them.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain, repeat

import numpy as np

from spanloom.llm.token_counts import resolve

# Unicode's White_Space (as in \\s of the tokenizers), and letters of Latin-1.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = ".,;:!?|*$%&#()"

#: Stretches that each of a worker's two generations keeps the ids of, besides those of the slice in hand.
MAX_KEPT = 300_000
#: Stretches whose ids are put behind each other at once.
AT_ONCE = 1 << 18
#: Characters of the texts whose stretches are in memory at once, as some ten times as many bytes, one text at least.
SLICE_CHARS = 1 << 19

_AFTER = f"(?![^{_WHITE}{_PLAIN}])"
SPACED = re.compile(f"[{_WHITE}]*+(?:[{_LETTERS}]++{_AFTER}|[^{_WHITE}]++)|[{_WHITE}]++")
UNSPACED = re.compile(f"[{_LETTERS}]+{_AFTER}|[^{_WHITE}]+")
_WHITES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WHITE}]", c))


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy a quarter longer than ``n`` if it is shorter than that."""
    return held if n <= len(held) else np.concatenate([held, np.zeros(n + n // 4 - len(held), held.dtype)])


class Kept:
    """Stretches and their ids, which stand behind each other in one array."""

    def __init__(self, dtype: str):
        self.place: dict[str, int] = {}
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, dtype)  # longer than what they hold, so that few additions move them

    def add(self, stretches: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.place), len(stretches)
        self.place.update(zip(stretches, range(n, n + m), strict=True))
        end = int(self.first[n])
        self.first, self.ids = _room(self.first, n + m + 1), _room(self.ids, end + len(ids))
        self.first[n + 1 : n + m + 1] = end + np.cumsum(lengths)
        self.ids[end : end + len(ids)] = ids

    def lengths(self, places: np.ndarray) -> np.ndarray:
        return self.first[places + 1] - self.first[places]

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many stretches, and how many are of each."""
        n = self.lengths(places)
        at = np.repeat(self.first[places] - np.cumsum(n) + n, n)
        return self.ids[at + np.arange(len(at))], n


class Encoder:
    """``keep_space``: white space belongs to tokens (byte-level BPE); else the tokenizer drops it."""

    def __init__(self, vocabulary: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolve(vocabulary))
        added = self.tokenizer.get_added_tokens_decoder()
        plain = {i: t.content for i, t in added.items() if t.special and "<" in t.content and not (t.lstrip or t.rstrip or t.single_word)}
        self.mark_id, self.mark = max(plain.items(), default=(-1, ""))
        self.stretch = SPACED if keep_space else UNSPACED
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.folds = all(one(f"a{c}") == one(f"A{c.upper()}") for c in "abcdefghijklmnopqrstuvwxyz")  # A-Z count as a-z
        #: Tokens that the library sees in texts as they stand: a text that holds one, in any case if A-Z are folded, is encoded whole.
        self.added = sorted({t.content.lower() if self.folds else t.content for t in added.values()})
        form = json.loads(self.tokenizer.to_str())
        cutter = form.get("pre_tokenizer") or {}
        plain_bytes = keep_space and not form.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        #: Bytes that each id stands for, a character of its piece each.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())]) if plain_bytes else None
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kept, self.before = Kept(self.dtype), Kept(self.dtype)

    def _encode_words(self, words: list[str]) -> list[str]:
        """Many stretches at once with nothing between them; those that are left."""
        left: list[str] = []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            after, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum([len(x.encode()) for x in part])
            last = np.minimum(np.searchsorted(after, wanted), len(after) - 1)
            if np.array_equal(after[last], wanted):
                self.kept.add(part, ids, np.diff(last, prepend=-1))
            else:
                left += part
        return left

    def _encode_new(self, new: list[str]) -> None:
        """Many stretches at once, if need be with a special token between them, which no stretch can hold; others one by one."""
        if self.n_bytes is not None:
            words, rest = [], []
            for x in new:
                (words if x[0] in _WHITES and x[-1] not in _WHITES else rest).append(x)
            new = rest + self._encode_words(words)
        alone = [x for x in new if "<" in x] if self.mark else new
        joined = [x for x in new if "<" not in x] if self.mark else []
        for k in range(0, len(joined), 4096):
            part = joined[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            marks = ids == self.mark_id
            self.kept.add(part, ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
        for k in range(0, len(alone), 4096):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(alone[k : k + 4096], add_special_tokens=False)]
            self.kept.add(alone[k : k + 4096], np.array(list(chain.from_iterable(ids)), self.dtype), np.array([len(x) for x in ids], np.int64))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        out: list[bytes] = []
        first, size = 0, 0
        for i, x in enumerate(texts):
            if i > first and size + len(x) > SLICE_CHARS:
                out += self._encode_slice(texts[first:i])
                first, size = i, 0
            size += len(x)
        return out + self._encode_slice(texts[first:])

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, whose stretches are all in memory at once.

        Stretches are kept in two generations: those in use move to the younger one, and the older one is
        dropped when the younger is full, so frequent stretches stay.
        """
        whole = {}
        folded = [x.encode().lower().decode() for x in texts] if self.folds else texts  # fewer distinct stretches
        for i, x in enumerate(folded):
            if any(t in x for t in self.added):
                whole[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype).tobytes()
        found: list[str] = []
        until = [0]
        for i, x in enumerate(folded):
            if i not in whole:
                found += self.stretch.findall(x)
            until.append(len(found))
        places = np.fromiter(map(self.kept.place.get, found, repeat(-1)), np.int64, len(found))
        absent = np.flatnonzero(places < 0)
        if len(absent):
            names = [found[k] for k in absent.tolist()]
            missing, older = set(names), self.before.place
            again = [x for x in missing if x in older]
            self.kept.add(again, *self.before.ids_of(np.fromiter(map(older.__getitem__, again), np.int64, len(again))))
            self._encode_new([x for x in missing if x not in older])
            places[absent] = np.fromiter(map(self.kept.place.__getitem__, names), np.int64, len(names))
        out, size, at = [], np.dtype(self.dtype).itemsize, np.append(0, np.cumsum(self.kept.lengths(places)))[until] if found else [0] * len(until)
        raw = b"".join(self.kept.ids_of(places[k : k + AT_ONCE])[0].tobytes() for k in range(0, len(places), AT_ONCE))
        for i in range(len(texts)):
            out.append(whole[i] if i in whole else raw[size * at[i] : size * at[i + 1]])
        if len(self.kept.place) > MAX_KEPT:
            self.before, self.kept = self.kept, Kept(self.dtype)
        return out


@functools.cache
def worker_encoder(vocabulary: str, keep_space: bool) -> Encoder:
    """One a Python worker, for all tasks that it runs."""
    return Encoder(vocabulary, keep_space)
