"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie; every node has a failure link (where matching goes on
once the longest vocabulary piece on the way is popped) and the number of pieces
popped on that link. A word's greedy longest-match length is found in one walk
over its characters, without building pieces: each step follows a trie edge, or
failure links whose precomputed counts are added. Words are walked once per
batch, however often they occur.

A text is lower-cased and split into runs of letters, runs of digits, and single
other signs; white space separates. A word's last character carries the
vocabulary's end mark. A word that no sequence of pieces spells is one unknown token.

Defined cases: null and empty texts have no words; very long texts and words are
read whole; repeated rows get a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_text, small_batches

#: Letters, digits, or one other sign.
WORD = re.compile(r"[^\W\d_]+|\d+|[^\s\w]|_")
END_MARK = "</w>"
CACHE_WORDS = 300_000


def read_vocabulary(path: str) -> list[tuple[tuple[int, ...], bool]]:
    """Pieces of a byte-level vocabulary file as (bytes, ends a word)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith(END_MARK)
            out.append((tuple(byte_of[c] for c in (piece[:-len(END_MARK)] if ends else piece)), ends))
    return out


class Automaton:
    """Trie over symbols (a byte, or 256 + byte for a word's last one) with
    failure links and popped-piece counts."""

    def __init__(self, pieces: list[tuple[tuple[int, ...], bool]]):
        self.edges: list[dict[int, int]] = [{}]
        is_piece = [False]
        for symbols, ends in pieces:
            if not symbols:
                continue
            node = 0
            for s in (*symbols[:-1], symbols[-1] + 256 * ends):
                nxt = self.edges[node].get(s)
                if nxt is None:
                    nxt = self.edges[node][s] = len(self.edges)
                    self.edges.append({})
                    is_piece.append(False)
                node = nxt
            is_piece[node] = True
        self.fail, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        queue = deque([0])
        while queue:  # by depth: a node's link depends on shorter ones only
            u = queue.popleft()
            for s, v in self.edges[u].items():
                if is_piece[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and s not in self.edges[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][s], n
                queue.append(v)

    def count(self, word: bytes) -> int:
        """Pieces of the word's greedy longest match; 0 if it cannot be spelled."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, n, last = 0, 0, len(word) - 1
        for i, s in enumerate(word):
            if i == last:
                s += 256
            nxt = edges[node].get(s)
            while nxt is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
                nxt = edges[node].get(s)
            node = nxt
        while node:  # what is still matched at the end
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: a row per input row; an unknown word
    counts as one token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(read_vocabulary(vocabulary_path))

        class Known(dict):
            def __missing__(self, word: str) -> int:
                n = automaton.count(word.encode())
                if len(self) >= CACHE_WORDS:
                    self.clear()
                if len(word) <= 64:
                    self[word] = n
                return n
        known = Known().__getitem__
        for b in small_batches(batches, 4 << 20):
            words, tokens, unknown = [], [], []
            for text in b.column(1).to_pylist():
                n = np.fromiter(map(known, WORD.findall(text.lower())), dtype=np.int64) if text else np.zeros(0, np.int64)
                odd = int((n == 0).sum())
                words.append(len(n))
                tokens.append(int(n.sum()) + odd)
                unknown.append(odd)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (words, tokens, unknown))],
                                             names=["doc_id", "n_words", "n_tokens", "n_unknown"])
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
