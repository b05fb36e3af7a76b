"""Operator 1, token counts: a trie of distinct pre-tokens with unigram forward scores at its nodes.

Pre-tokens are the runs ``[^\\x20\\x09-\\x0D]+``, each with the word mark ahead of it. A pre-token's
tokens are the segmentation into vocabulary pieces with the greatest sum of the vocabulary's scores,
ties to the longer last piece; a character in no piece counts one token for each of its UTF-8 bytes.
The new distinct pre-tokens of a slice of text go into a trie in sorted order, so that the path of the
trie in hand is a stack: a node holds the best score and the token count of its prefix and the state
of an automaton that lists the pieces ending there. What neighbours share stays on the stack, so
every shared prefix is scored once. The count at a pre-token's last node (its terminal) is kept,
and further occurrences are one look-up.

The trie in hand is one path, and at most ``MAX_KEPT`` terminals outlast a slice; forgetting them
changes no count. No shuffle, no state on the driver: a lost task is simply run again.

Defined results: null and empty text have no tokens; repeated rows get one row each; ids may be
null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx

#: Terminals that a task keeps from slice to slice of its text.
MAX_KEPT = 300_000
SLICE_BYTES = 1 << 23
MARK = "▁"


def resolve(vocabulary: str) -> str:
    """A path, or the name of an installed public vocabulary."""
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def load_pieces(vocabulary: str) -> dict[str, float]:
    """Scores of the normal pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=resolve(vocabulary))
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


class PieceTrie:
    """Scores pre-tokens along shared prefixes; ``counts`` holds the terminals."""

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.counts: dict[bytes, int] = {}
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, float]]] = [[]]
        for piece, score in pieces.items():
            state = 0
            for c in piece:
                if c not in self.goto[state]:
                    self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append([])
                state = self.goto[state][c]
            self.ends[state].append((len(piece), score))
        self.fail = [0] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:  # grows as it is read: breadth first
            for c, child in self.goto[state].items():
                queue.append(child)
                self.fail[child] = self._next(self.fail[state], c)
                self.ends[child] += self.ends[self.fail[child]]  # longest first

    def _next(self, state: int, c: str) -> int:
        while c not in self.goto[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.goto[state][c]

    def add(self, found: set[bytes]) -> None:
        """Score the pre-tokens that have no terminal yet."""
        new = sorted(MARK + x.decode() for x in found if x not in self.counts)
        if len(self.counts) + len(new) > MAX_KEPT:
            self.counts.clear()
            new = sorted(MARK + x.decode() for x in found)
        state, score, count = [0], [0.0], [0]
        before = ""
        for word in new:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del state[shared + 1 :], score[shared + 1 :], count[shared + 1 :]
            for end in range(shared, len(word)):
                c = word[end]
                at = self._next(state[-1], c)
                best, tokens, length = float("-inf"), 0, 0
                for length, piece in self.ends[at]:
                    if score[end + 1 - length] + piece > best:
                        best, tokens = score[end + 1 - length] + piece, count[end + 1 - length] + 1
                if length != 1 and score[end] + self.unknown > best:  # the character itself is no piece
                    best, tokens = score[end] + self.unknown, count[end] + len(c.encode())
                state.append(at)
                score.append(best)
                count.append(tokens)
            self.counts[word[1:].encode()] = count[-1]
            before = word


@functools.cache
def _worker_trie(vocabulary: str) -> PieceTrie:
    """One a Python worker: its terminals serve all tasks that the worker runs."""
    return PieceTrie(load_pieces(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_words, n_tokens: one row per row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = _worker_trie(vocabulary)
            data, offsets = tx.doc_bytes(batch.column(1))
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j in tx.doc_slices(offsets, SLICE_BYTES):
                found = [data[offsets[d] : offsets[d + 1]].tobytes().split() for d in range(i, j)]
                trie.add(set().union(*found))
                for d, pre_tokens in enumerate(found, i):
                    words[d], tokens[d] = len(pre_tokens), sum(map(trie.counts.__getitem__, pre_tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_words long, n_tokens long")
