"""Harmonic packing of token sequences.

A document's tokens (with an end id) are cut into full sequences, then into
powers of two down to ``MIN_CUT``, then a tail. A piece of length L belongs to
the reciprocal class k = capacity // L; a bin of class k takes exactly k pieces,
so workers fill bins on their own and nothing is shuffled. Power-of-two classes
fill their bins to the last token; a tail wastes at most 1/(k+1) of its bin. The
few pieces of a worker's unfilled bins are put end to end, cut again at the
capacity, and the last stretch at powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone; very long texts are cut
like any other; a null id and repeated rows are kept as they are; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import id_text, small_batches

CAPACITY = 2048
MIN_CUT = 64
END_ID = 1
CACHE_ENTRIES = 200_000
LONG_CHUNK = 10_000  # from this length on, the pattern may need more stack than it has
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A run of non-blanks with the blank before it, or blanks; the tokenizer's own
#: pattern never joins text across these borders, so each can be encoded alone.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A word of Latin letters and the marks after it, which the pattern takes as two pieces.
WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ſ]+)([.,;:!?)\]}\"]*)")
#: Blanks to Python but not to the tokenizer's pattern.
ODD_BLANKS = re.compile(r"[\x1c-\x1f]")
#: Without such a run, no run of blanks crosses a cut before a blank.
BLANK_RUN = re.compile(r"\s ")


def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit bytes, as the tokenizer
    file at ``path`` (byte-level BPE) gives them without added special tokens.
    Words are encoded once and kept in a cache of bounded size; a text with one
    of the vocabulary's special strings or odd control characters goes to the
    file's own tokenizer as a whole."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = Tokenizer.from_file(path)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    letters = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    others = [b for b in range(256) if b not in letters]
    byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    model = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merge, merge_piece = model.encode_ordinary, model._encode_single_piece

    def long_ids(chunk: str) -> bytes:
        try:
            return model.encode_to_numpy(chunk, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # a run of blanks too long for the pattern's stack
            return array("I", whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    class Words(dict):
        """Chunk -> ids; a chunk of inner blanks (a line break between words) is taken apart."""

        def __missing__(self, chunk: str) -> bytes:
            word = WORD.fullmatch(chunk)
            if word is None:
                parts = chunks(chunk)
                if len(parts) > 1:
                    return b"".join(map(known, parts))
                ids = array("I", merge(chunk)).tobytes() if len(chunk) < LONG_CHUNK else long_ids(chunk)
            elif word[2]:
                ids = self[word[1]] + self[word[2]]
            else:
                ids = array("I", merge_piece(chunk)).tobytes()
            if len(chunk) <= 40:
                if len(self) >= cache_entries:
                    self.clear()
                self[chunk] = ids
            return ids

    known, chunks = Words().__getitem__, CHUNK.findall

    def encode(text: str) -> bytes:
        if any(s in text for s in special) or ODD_BLANKS.search(text):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        if BLANK_RUN.search(text):
            return b"".join(map(known, chunks(text)))
        return b"".join(map(known, text.replace(" ", "\x1e ").split("\x1e")))  # cut before every blank
    return encode


def cuts(n: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest, power = n % capacity, capacity // 2
    while power >= min_cut:
        if rest >= power:
            out.append(power)
            rest -= power
        power //= 2
    return out + [rest] if rest else out


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Bins of one worker. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, min_cut: int = MIN_CUT):
        self.next, self.capacity, self.min_cut = first_sequence, capacity, min_cut
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            size = len(ids) // 4
            self.rows.append((doc_id, start, size, zlib.crc32(ids), total, self.next, at))
            at += size
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        for size in cuts(total, self.capacity, self.min_cut):
            count = self.capacity // size
            pieces = self.open.setdefault(count, [])
            pieces.append((doc_id, at, ids[4 * at:4 * (at + size)], total))
            at += size
            if len(pieces) == count:
                self._emit(self.open.pop(count))

    def finish(self) -> None:
        """The unfilled bins' pieces, end to end."""
        rest = [p for count in sorted(self.open) for p in self.open[count]]
        self.open = {}
        total = sum(len(p[2]) // 4 for p in rest)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        k, inside = 0, 0
        for size in sizes:
            pieces, need = [], size
            while need:
                doc_id, start, ids, tokens = rest[k]
                take = min(need, len(ids) // 4 - inside)
                pieces.append((doc_id, start + inside, ids[4 * inside:4 * (inside + take)], tokens))
                need, inside = need - take, inside + take
                if inside == len(ids) // 4:
                    k, inside = k + 1, 0
            self._emit(pieces)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, min_cut: int = MIN_CUT) -> DataFrame:
    """A row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in its sequence)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, min_cut)
        for b in small_batches(batches, 4 << 20):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc_id, (encode(text) if text else b"") + end)
            yield packer.take()
        packer.finish()
        yield packer.take()
    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
