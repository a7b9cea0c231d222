"""Exact duplicates by an extendible-hash index on shared files.

1. Tasks cut their rows into runs of bounded size, delete white space, and keep
   each distinct text of a run once (an entry): copies are counted before any
   shuffle. Rows and entries go to the shared folder.
2. A directory of 2^depth slots maps the leading bits of a text's 64-bit key to
   buckets. A bucket that holds more than its capacity is split by one more bit;
   when its depth passes the directory's, the directory doubles. One key alone
   cannot be split: if its entries overflow a bucket (a text that most runs hold),
   they are first merged in slices, by the same comparison.
3. Owner tasks take ranges of consecutive buckets, a bucket in memory at a time.
   Entries of one key are chained, and an entry joins the one whose bytes are
   equal, so a collision of keys never joins two texts. The records, with the
   group's size and the row that stays, are the index; rows find theirs through
   the entry of their run, of which no key has more rows than a run.

Of equal texts the row with the most code points in its original text stays,
then the one with the smallest id (null last), then one of the equal rows.

Defined cases: a null text counts as empty; empty and blank texts are one group;
very long texts are compared whole (a bucket may hold one text above capacity);
a null id and repeated rows keep a row each, with one row kept in a group; an
empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches, store

RUN_BYTES = 32 << 20
BUCKET_BYTES = 32 << 20
#: The directory has at most about 2^20 buckets; beyond that their capacity grows instead.
MAX_BUCKETS = 1 << 20
#: Tasks that share the entries of a key that overflows its bucket.
SLICES = 64
BLANKS = b" \t\n\v\f\r"

_ENTRY = [("ref", pa.int64()), ("key", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64()),
          ("best_row", pa.int64())]
_STORED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_chars", pa.int64()), *_ENTRY])
_STORED_SQL = "doc_id long, row long, n_chars long, ref long, key long, body binary, n long, best_chars long, best_id long, best_row long"


def _better(a: tuple, b: tuple) -> tuple:
    """The row that stays, of two (code points, id, row)."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1], x[2]))


def text_key(body: bytes, bits: int = 64) -> int:
    """Signed 64-bit key; with fewer ``bits`` only the leading ones are kept."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(body) >> (64 - bits) << (64 - bits))))


class _Entries:
    """Distinct texts of one run: body -> [ref, key, rows, best row]."""

    def __init__(self, bits: int):
        self.bits, self.size, self.found = bits, 0, {}

    def add(self, body: bytes, ref: int, n: int, best: tuple, key: int | None = None) -> int:
        e = self.found.get(body)
        if e is None:
            self.found[body] = [ref, text_key(body, self.bits) if key is None else key, n, best]
            self.size += len(body) + 200
            return ref
        e[2] += n
        e[3] = _better(e[3], best)
        return e[0]

    def batches(self, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for body, (ref, key, n, best) in self.found.items():
            part.append((ref, key, body, n, *best))
            size += len(body)
            if size > most:
                yield _stored(entries=part)
                part, size = [], 0
        if part:
            yield _stored(entries=part)
        self.size, self.found = 0, {}


def _stored(rows: list[tuple] = (), entries: list[tuple] = ()) -> pa.RecordBatch:
    """Rows are (doc_id, row, n_chars, ref)."""
    if entries:
        columns = [[None] * len(entries)] * 3 + list(zip(*entries))
    else:
        columns = list(zip(*rows)) + [[None] * len(rows)] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STORED)], schema=_STORED)


def _cut_runs(rows: DataFrame, bits: int, run_bytes: int) -> DataFrame:
    """The rows (body null) with their entry, and the entries of every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        at = TaskContext.get().partitionId() << 40
        entries = _Entries(bits)
        for b in small_batches(batches):
            texts, out = pc.fill_null(b.column(1), ""), []
            for doc_id, chars, text in zip(b.column(0).to_pylist(), pc.utf8_length(texts).to_pylist(), texts.cast(pa.binary()).to_pylist()):
                ref = entries.add(text.translate(None, BLANKS), at, 1, (chars, doc_id, at))
                out.append((doc_id, at, chars, ref))
                at += 1
            if out:
                yield _stored(rows=out)
            if entries.size > run_bytes:
                yield from entries.batches()
        yield from entries.batches()
    return rows.mapInArrow(run, _STORED_SQL)


def _merge_slices(entries: DataFrame, slices: int, run_bytes: int) -> DataFrame:
    """Entries of overflowing keys, merged in slices: new entries with refs of their
    own (negative), and for every old one a row (doc_id = old ref, ref = new ref)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Entries(64)
        for b in small_batches(batches):
            out = []
            for ref, key, body, n, *best in zip(*(c.to_pylist() for c in b.columns)):
                out.append((ref, None, None, merged.add(body, -ref - 1, n, tuple(best), key)))
            yield _stored(rows=out)
            if merged.size > run_bytes:
                yield from merged.batches()
        yield from merged.batches()
    dealt = entries.repartition(F.col("key"), F.pmod(F.xxhash64("ref"), F.lit(slices)))
    return dealt.select([n for n, _ in _ENTRY]).mapInArrow(run, _STORED_SQL)


class Directory:
    """Slots of an extendible hash: the leading ``depth`` bits of a key give the
    slot, the slot its bucket. Buckets are (prefix, local depth) in key order."""

    def __init__(self, depth: int = 0):
        self.depth = depth
        self.buckets = [(p, depth) for p in range(1 << depth)]

    def split(self, overfull: set[int]) -> None:
        """Split the buckets with these numbers; the directory doubles if one passes its depth."""
        out = []
        for k, (prefix, local) in enumerate(self.buckets):
            out += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)] if k in overfull else [(prefix, local)]
        self.buckets = out
        self.depth = max(self.depth, max(local for _, local in out))

    def slots(self) -> np.ndarray:
        """Bucket number of every slot."""
        return np.repeat(np.arange(len(self.buckets)), [1 << (self.depth - local) for _, local in self.buckets])

    def slot(self, key: Column) -> Column:
        return F.shiftrightunsigned(key, 64 - self.depth) if self.depth else F.lit(0).cast("long")

    def locate(self, df: DataFrame) -> DataFrame:
        """Add the bucket of each row's key. The directory is sent to the tasks: at
        most a few million slots, as buckets are at most ``MAX_BUCKETS``."""
        import pandas as pd
        slots = self.slots()
        table = df.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(len(slots)), "bucket": slots.astype("int32")}), "slot long, bucket int")
        return df.withColumn("slot", self.slot(F.col("key"))).join(F.broadcast(table), "slot").drop("slot")


def build_directory(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Directory:
    """Double and split until no bucket holds more than its capacity besides its
    longest text. Reads keys and lengths only, stored beside the bodies."""
    sized = entries.select("key", F.octet_length("body").cast("long").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    capacity = max(bucket_bytes, total // (MAX_BUCKETS // 4))
    directory = Directory(max(0, math.ceil(math.log2(max(1, 2 * total / capacity)))))
    while True:
        filled = directory.locate(sized).groupBy("bucket").agg(F.sum("size").alias("size"), F.max("size").alias("longest"),
                                                              F.min("key").alias("low"), F.max("key").alias("high"))
        overfull = {r["bucket"] for r in filled.where((F.col("size") - F.col("longest") > capacity) & (F.col("low") < F.col("high"))).select("bucket").collect()}
        if not overfull:
            return directory
        directory.split(overfull)


def _settle(entries: DataFrame, directory: Directory) -> DataFrame:
    """Owner tasks: for every entry its bucket, place in its key's chain, group size and the row that stays."""
    n = len(directory.buckets)
    owners = min(n, max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chains = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for key, chain in chains.items():
                for place, (body, rows, best, refs) in enumerate(chain):
                    k, digest = len(refs), hashlib.sha256(body).digest()
                    for i in range(0, k, 1 << 16):
                        part = refs[i:i + (1 << 16)]
                        out.append((part, [now] * len(part), [key] * len(part), [place] * len(part), [digest] * len(part), [rows] * len(part),
                                    [best[1]] * len(part), [best[2]] * len(part)))
                        if sum(len(x[0]) for x in out[-64:]) >= 1 << 14:
                            yield flush()
            chains.clear()

        def flush() -> pa.RecordBatch:
            columns = [[v for part in c for v in part] for c in zip(*out)] if out else [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD)], schema=_RECORD)
        out: list[tuple] = []
        for b in small_batches(batches):
            for bucket, ref, key, body, rows, *best in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    yield from done()
                    now = bucket
                chain = chains.setdefault(key, [])
                for e in chain:
                    if e[0] == body:
                        e[1] += rows
                        e[2] = _better(e[2], tuple(best))
                        e[3].append(ref)
                        break
                else:
                    chain.append([body, rows, tuple(best), array("q", [ref])])
        yield from done()
        yield flush()
    located = directory.locate(entries).select("bucket", *[c for c, _ in _ENTRY])
    owner = F.floor(F.col("bucket").cast("long") * owners / F.lit(n)).cast("int")
    return located.repartitionById(owners, owner).sortWithinPartitions("bucket").mapInArrow(run, _RECORD_SQL)


_RECORD = pa.schema([("ref", pa.int64()), ("bucket", pa.int32()), ("key", pa.int64()), ("place", pa.int32()), ("sha", pa.binary()), ("group_size", pa.int64()),
                     ("keep_id", pa.int64()), ("keep_row", pa.int64())])
_RECORD_SQL = "ref long, bucket int, key long, place int, sha binary, group_size long, keep_id long, keep_row long"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, run_bytes: int = RUN_BYTES,
                 slices: int = SLICES, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the text without white
    space): one row per input row. ``key_bits`` shortens the index key (tests)."""
    stored = store(_cut_runs(id_text(docs, id_col, text_col), key_bits, run_bytes), "exact-runs")
    rows = stored.where("body is null").select("doc_id", "row", "ref")
    entries = stored.where("body is not null").select([n for n, _ in _ENTRY])
    # Keys whose entries overflow a bucket: each stands for bucket_bytes of entries, so the list is a millionth of the table.
    heavy = entries.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.octet_length("body").cast("long")).alias("size"))
    heavy = heavy.where((F.col("k") > 1) & ((F.col("size") > bucket_bytes) | (F.col("k") > bucket_bytes // 16))).select("key")
    if heavy.limit(1).count():
        heavy = store(heavy, "exact-heavy")
        merged = store(_merge_slices(entries.join(heavy, "key", "left_semi"), slices, run_bytes), "exact-merged")
        moved = merged.where("body is null").select(F.col("doc_id").alias("ref"), F.col("ref").alias("new_ref"))
        rows = rows.join(moved, "ref", "left").select("doc_id", "row", F.coalesce("new_ref", "ref").alias("ref"))
        entries = entries.join(heavy, "key", "left_anti").unionByName(merged.where("body is not null").select(entries.columns))
    index = store(_settle(entries, build_directory(entries, bucket_bytes)), "exact-index")
    return rows.join(index, "ref").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                                          F.lower(F.hex("sha")).alias("text_sha256"))
