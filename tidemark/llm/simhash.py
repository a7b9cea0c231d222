"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Links are all pairs of
fingerprints within ``radius`` bits. Distinct fingerprints are dealt to buckets
by the pigeonhole rule (of radius + k bit blocks at least k agree), so no link
is lost. In a bucket the fingerprints are stored as vertical bit planes: one
machine word holds one bit of 64 fingerprints, and a carry-save counter adds a
plane to 64 distances at once; a block is abandoned once all its distances
exceed the radius. A bucket emits a spanning forest of its links, never all
pairs.

Defined cases: a null or blank text has no shingle and fingerprint zero, which
links like any other; fewer words than a shingle give one shingle of all words;
repeated rows and ids stay one row each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches, store, texts_of
from tidemark.llm.components import connected_components

BITS = 64
BUCKET = 2048          # aimed-at distinct fingerprints in a bucket
BLOCK = 4096           # a larger bucket is compared block against block
QUERY_ROWS = 512


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: a bit is 1 if set in over half the shingle hashes."""
    from xxhash import xxh64_intdigest as xxh
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh(b" ".join(words), seed)
    ones, n = np.zeros(BITS, dtype=np.int64), len(words) - shingle + 1
    for i in range(0, n, 1 << 16):  # a very long text is counted piece by piece
        part = words[i:i + (1 << 16) + shingle - 1]
        hashes = np.array([xxh(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(shingle)))], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in texts_of(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical layout: row b holds bit b of all fingerprints, 64 to a word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, block: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i) of ``queries`` and the bit mask (64 to a word) of ``block`` members
    within ``radius`` bits, for the rows that have any."""
    planes = planes_of(block)
    words = planes.shape[1]
    outside = np.zeros(words * 64, dtype=np.uint8)
    outside[len(block):] = 1
    ended = np.packbits(outside, bitorder="little").view("<u8")
    alive = np.arange(len(queries))
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius  # so that the counter overflows at radius + 1
    counter = [np.full((len(queries), words), -(start >> k & 1), dtype=np.int64).view(np.uint64) for k in range(width)]
    over = np.repeat(ended[None, :], len(queries), axis=0)
    share = np.array([np.bitwise_count(p).sum() for p in planes]) / max(1, len(block))
    order = np.argsort(-np.minimum(share, 1 - share), kind="stable")  # most telling planes first
    for step in range(0, BITS, 2):
        p, q = int(order[step]), int(order[step + 1])
        x = planes[p][None, :] ^ (np.uint64(0) - (queries >> np.uint64(p) & np.uint64(1)))[:, None]
        y = planes[q][None, :] ^ (np.uint64(0) - (queries >> np.uint64(q) & np.uint64(1)))[:, None]
        both = counter[0] ^ x
        carry = (counter[0] & x) | (both & y)   # full adder: counter bit 0 + two planes
        counter[0] = both ^ y
        for k in range(1, width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if step % 8 == 6:
            live = ~(over == np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            if not live.all():
                alive, queries, over = alive[live], queries[live], over[live]
                counter = [c[live] for c in counter]
                if not len(alive):
                    break
    return alive, ~over


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = 3) -> list[tuple[int, int]]:
    """Spanning forest (member, smallest member of its tree) of the links inside
    ``a``, or between ``a`` and ``b``, as positions in a followed by b."""
    members = a if b is None else np.concatenate([a, b])
    base, block = (0, a) if b is None else (len(a), b)
    label = np.arange(len(members))
    for i in range(0, len(a), QUERY_ROWS):
        rows, mask = within(a[i:i + QUERY_ROWS], block, radius)
        hits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
        if b is None and len(rows):
            hits[np.arange(len(rows)), rows + i] = 0  # not itself
        for r in np.flatnonzero(hits.any(axis=1)):
            near = label[np.append(base + np.flatnonzero(hits[r]), i + rows[r])]
            trees = np.unique(near)
            if len(trees) > 1:
                label[np.isin(label, trees)] = trees[0]
    return [(int(k), int(label[k])) for k in np.flatnonzero(label != np.arange(len(members)))]


def _tables(n: int, radius: int) -> tuple[list[list[tuple[int, int]]], int]:
    """Which bit ranges (low bit, width) make up the key of each table, and the
    key's length, so that a bucket of n even fingerprints holds about BUCKET."""
    need = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    if need == 0:
        return [[]], 0
    k = 1
    while k < 8 and sum(sorted(np.diff(np.linspace(0, BITS, radius + k + 1).astype(int)))[:k]) < need:
        k += 1
    cuts = np.linspace(0, BITS, radius + k + 1).astype(int)
    ranges = [(int(lo), int(hi - lo)) for lo, hi in zip(cuts[:-1], cuts[1:])]
    need = min(need, sum(sorted(w for _, w in ranges)[:k]))
    return [list(c) for c in combinations(ranges, k)], need


def links(distinct_fps: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """(u, v): a spanning set of the links between distinct fingerprints (column
    ``fp``; ``n`` is their number)."""
    tables, need = _tables(n, radius)
    keys = []
    for t, ranges in enumerate(tables):
        key, left = F.lit(0).cast("long"), need
        for lo, width in ranges:
            take = min(width, left)
            left -= take
            if take:
                part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << take) - 1))
                key = F.shiftleft(key, take).bitwiseOR(part.cast("long"))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    members = distinct_fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    large = (members.groupBy("t", "key").count().where(F.col("count") > BLOCK)
             .select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    members = (members.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
               .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda x: F.struct(F.least("part", x).alias("a"), F.greatest("part", x).alias("b")))
    dealt = members.select("fp", "t", "key", "part", F.explode(pairs).alias("ab")).select("fp", "t", "key", "part", "ab.a", "ab.b")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fp, part = group["fp"].to_numpy(np.int64), group["part"].to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, part = fp[order], part[order]
        if key[2] == key[3]:
            members, found = fp, forest(fp.view(np.uint64), None, radius)
        else:
            a, b = fp[part == key[2]], fp[part == key[3]]
            members, found = np.concatenate([a, b]), forest(a.view(np.uint64), b.view(np.uint64), radius)
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": members[pairs[:, 0]], "v": members[pairs[:, 1]]})
    return dealt.groupBy("t", "key", "a", "b").applyInPandas(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row; component_id is
    the smallest doc_id reachable over links, its own included."""
    fps = store(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(links(distinct, distinct.count(), radius))
    placed = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
