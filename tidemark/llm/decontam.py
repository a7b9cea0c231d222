"""Benchmark decontamination by a distributed positional inverted index.

Documents are indexed in segments of bounded size; a segment stores, for every
term that the test items hold, the sorted positions at which it occurs (a term
outside them can be in no intersection). Segments are written to the shared
folder. Test windows are then looked up in each segment: starting from the
window's rarest term, each further posting list is shifted by the term's offset
and intersected. A gap between documents keeps matches from crossing them. The
exact phrase matches give hit words; the proximity matches allow each term a
few words of drift and a fifth of the terms missing. They depend on the document
alone, not on the segment it is in.

Test items are taken in blocks of a fixed number of words, so what is broadcast
is bounded however large the test set is.

Defined cases: null and empty texts have no words (and a document without words
is never contaminated); items without words or without an id are left out;
repeated items count once per item_id; an empty test set hits nothing; an empty
document table gives an empty table; repeated document rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches, store, texts_of

WINDOW = 13
BLOCK_WORDS = 1_000_000      # words of test items in one broadcast
SEGMENT_WORDS = 1 << 19      # words in one index segment (a longer document has its own)
CANDIDATES = 1 << 21         # candidate positions examined at a time

#: Bytes that separate words become blanks; A-Z become a-z; digits, a-z and all non-ASCII bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


@dataclass
class Tests:
    """Windows of a block of test items, as term numbers from 1."""
    vocabulary: dict[bytes, int]
    items: list[str]
    windows: list[tuple[np.ndarray, np.ndarray]]  # by length: (windows x length terms, item of each)


def make_tests(rows: list[tuple[int, str]], window: int = WINDOW) -> Tests:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    by_length: dict[int, dict[tuple[int, ...], None]] = {}
    for item, text in rows:
        terms = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text.encode())]
        if terms:
            no, size = names.setdefault(str(item), len(names)), min(window, len(terms))
            for i in range(len(terms) - size + 1):
                by_length.setdefault(size, {})[(no, *terms[i:i + size])] = None
    windows = []
    for _, found in sorted(by_length.items()):
        grid = np.array(list(found), dtype=np.int32)
        windows.append((grid[:, 1:], grid[:, 0]))
    return Tests(vocabulary, list(names), windows)


SEGMENT_SCHEMA = "doc_ids binary, no_id binary, starts binary, terms binary, counts binary, postings binary"


def index_segments(docs: DataFrame, tests: Broadcast, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index: a row per segment with its documents, word starts and postings
    (little-endian arrays: terms, their counts, their positions in term order).
    Position of a word: its number in the segment plus its document's number."""
    def segment(ids: list[int | None], parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one gap after each document
        terms = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.arange(len(terms)) + np.repeat(np.arange(len(parts)), sizes)
        at, terms = at[terms > 0], terms[terms > 0]
        order = np.argsort(terms, kind="stable")
        found, counts = np.unique(terms, return_counts=True)
        cells = [np.array([i or 0 for i in ids], dtype="<i8"), np.array([i is None for i in ids], dtype=np.uint8), starts.astype("<i8"),
                 found.astype("<i4"), counts.astype("<i4"), at[order].astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                          names=["doc_ids", "no_id", "starts", "terms", "counts", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = tests.value.vocabulary.get
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0
        for b in small_batches(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                part = np.array([number(w, 0) for w in words(text)], dtype=np.int32)
                if ids and held + len(part) > segment_words:
                    yield segment(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(doc_id)
                parts.append(part)
                held += len(part)
        if ids:
            yield segment(ids, parts)
    return docs.mapInArrow(run, SEGMENT_SCHEMA)


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.no_id = np.frombuffer(row["no_id"], np.uint8).astype(bool)
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<i4")
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.postings = np.frombuffer(row["postings"], "<i4").astype(np.int64)
        self.length = int(self.starts[-1])
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * (self.length + 1) + self.postings

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand in this segment's list; -1 if absent."""
        if not len(self.terms):
            return np.full(terms.shape, -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, place: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the posting list at ``place`` has the position."""
        return (position >= 0) & (position < self.length) & self.between(place, position, position)

    def between(self, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the posting list at ``place`` has a position from ``first`` to ``last``, both inside the segment."""
        low, high = place * (self.length + 1) + first, place * (self.length + 1) + last
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        return (place >= 0) & (self.keys[at] >= low) & (self.keys[at] <= high)


def _candidates(seg: Segment, place: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) for every posting of each window's chosen term, in chunks."""
    rows = np.flatnonzero(place >= 0)
    sizes = seg.counts[place[rows]]
    cut = np.searchsorted(np.cumsum(sizes), np.arange(CANDIDATES, int(sizes.sum()) + CANDIDATES, CANDIDATES), "right") + 1
    for part in np.split(np.arange(len(rows)), np.unique(cut[cut < len(rows)])):
        w, n = rows[part], sizes[part]
        if n.sum():
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = np.repeat(w, n)
            yield window, seg.postings[seg.first[place[window]] + within] - offset[window]


def phrase_matches(seg: Segment, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of every exact occurrence of the windows."""
    place = seg.place(terms)
    df = np.where(place >= 0, seg.counts[place] if len(seg.counts) else 0, 0)
    able = (place >= 0).all(axis=1)
    order = np.argsort(df, axis=1, kind="stable")
    rarest = np.where(able, np.take_along_axis(place, order[:, :1], axis=1)[:, 0], -1)
    found_w, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for window, start in _candidates(seg, rarest, order[:, 0]):
        for k in range(1, terms.shape[1]):
            if not len(window):
                break
            off = order[window, k]
            kept = seg.holds(place[window, off], start + off)
            window, start = window[kept], start[kept]
        found_w.append(window)
        found_p.append(start)
    return np.concatenate(found_w), np.concatenate(found_p)


def proximity_matches(seg: Segment, terms: np.ndarray, drift: int = 2, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of one of its terms) where, for some start, at least
    ``share`` of the terms stand within ``drift`` words of their place in the
    window, all in one document. Some of the rarest terms, one more than may be
    missing, must be among them, so their postings are the places to look at."""
    place = seg.place(terms)
    df = np.where(place >= 0, seg.counts[place] if len(seg.counts) else 0, 0)
    size = terms.shape[1]
    need = math.ceil(share * size)
    able = (place >= 0).sum(axis=1) >= need
    order = np.argsort(df, axis=1, kind="stable")
    low, high = seg.starts[:-1], seg.starts[1:] - 2  # first and last word of each document

    def near_enough(window: np.ndarray, start: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
        """Which candidates have enough terms within ``reach``; rows are given up once too many are missing."""
        rows, near = np.arange(len(window)), np.zeros(len(window), dtype=np.int64)
        for k in range(size):
            w, d = window[rows], doc[rows]
            off = order[w, k]
            near = near + seg.between(place[w, off], np.maximum(start[rows] + off - reach, low[d]), np.minimum(start[rows] + off + reach, high[d]))
            kept = near + size - 1 - k >= need
            rows, near = rows[kept], near[kept]
        return rows

    found_w, found_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(size - need + 1):
        anchor = np.where(able, np.take_along_axis(place, order[:, k:k + 1], axis=1)[:, 0], -1)
        for window, start in _candidates(seg, anchor, order[:, k]):
            position = start + order[window, k]
            doc = np.searchsorted(seg.starts, position, "right") - 1
            rows = near_enough(window, start, doc, 2 * drift)  # whatever the start is, the terms are that near
            for shift in range(-drift, drift + 1):
                kept = rows[near_enough(window[rows], start[rows] + shift, doc[rows], drift)]
                found_w.append(window[kept])
                found_p.append(position[kept])
    return np.concatenate(found_w), np.concatenate(found_p)


MATCH_SCHEMA = ("doc_id long, n_words long, hits array<struct<first:long,last:long>>, "
                "items array<string>, near_items array<string>")


def match(index: DataFrame, tests: Broadcast, drift: int | None = None) -> DataFrame:
    """A row per indexed document: its words hit by exact windows, as merged
    ranges [first, last] of word numbers, and the items matched exactly and,
    unless ``drift`` is None, nearly."""
    def one(row: dict) -> pa.RecordBatch:
        seg, block = Segment(row), tests.value
        n = len(seg.doc_ids)
        edge = np.zeros(seg.length + 2, dtype=np.int64)
        pairs: dict[str, list[np.ndarray]] = {"exact": [np.zeros((0, 2), np.int64)], "near": [np.zeros((0, 2), np.int64)]}
        for terms, item in block.windows:
            window, start = phrase_matches(seg, terms)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + terms.shape[1], -1)
            doc = np.searchsorted(seg.starts, start, "right") - 1
            pairs["exact"].append(np.unique(np.stack([doc, item[window]], axis=1), axis=0))
            if drift is not None:
                window, position = proximity_matches(seg, terms, drift)
                doc = np.searchsorted(seg.starts, position, "right") - 1
                pairs["near"].append(np.unique(np.stack([doc, item[window]], axis=1), axis=0))
        flags = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
        first, last = np.flatnonzero(flags == 1), np.flatnonzero(flags == -1) - 1
        doc = np.searchsorted(seg.starts, first, "right") - 1
        hits: list[list[dict]] = [[] for _ in range(n)]
        for d, a, b in zip(doc, first, last):
            hits[d].append({"first": int(a - seg.starts[d]), "last": int(b - seg.starts[d])})
        lists = {}
        for kind, found in pairs.items():
            lists[kind] = [[] for _ in range(n)]
            for d, i in np.unique(np.concatenate(found), axis=0):
                lists[kind][d].append(block.items[i])
        ids = [None if gone else int(i) for i, gone in zip(seg.doc_ids, seg.no_id)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(seg.starts) - 1, pa.int64()),
             pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
             pa.array(lists["exact"], pa.list_(pa.string())), pa.array(lists["near"], pa.list_(pa.string()))],
            names=["doc_id", "n_words", "hits", "items", "near_items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield one(b.slice(i, 1).to_pylist()[0])
    return index.mapInArrow(run, MATCH_SCHEMA)


def _merged(ranges: Column) -> Column:
    """Sorted word ranges -> number of distinct words in them."""
    zero = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(ranges), zero, lambda s, r: F.struct(
        F.greatest(s["upto"], r["last"]).alias("upto"),
        (s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(s["upto"], r["first"] - 1))).alias("n")))["n"]


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  drift: int | None = None, block_words: int = BLOCK_WORDS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, near_items, contaminated: a row per document
    row; near_items are the items of which, for a window and some start in the
    document, four fifths of the terms stand within ``drift`` words of their place; they are looked for if it is given. A word is hit if it lies in an occurrence of a window (``window``
    consecutive item words; a shorter item is one window). contaminated: at
    least a twentieth of the words are hit."""
    spark = docs.sparkSession
    items = (tests.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
             .where("item is not null and text is not null").distinct())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 2 / block_words))  # a word and its blank take two characters at least
    source = id_text(docs, id_col, text_col)
    if blocks > 1:
        source = store(source.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    parts, cuts = [], F.pmod(F.xxhash64("item"), F.lit(blocks))
    for k in range(blocks):
        sent = spark.sparkContext.broadcast(make_tests([tuple(r) for r in items.where(cuts == k).collect()], window))
        index = index_segments(source.select("row" if blocks > 1 else "doc_id", "text"), sent, segment_words)
        parts.append(match(store(index, "decontam-index"), sent, drift))
    if blocks == 1:
        found = parts[0]
    else:  # here the indexed id is the row; put the blocks' findings together by it
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        found = (every.groupBy(F.col("doc_id").alias("row"))
                 .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
                      F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"))
                 .join(source.select("row", "doc_id"), "row"))
    n_hit = F.when(F.size("hits") == 0, F.lit(0).cast("long")).otherwise(_merged(F.col("hits")))
    return (found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"),
                         F.array_sort(F.array_distinct("near_items")).alias("near_items"))
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")))
