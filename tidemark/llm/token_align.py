"""Alignment of two tokenizers' tokens by diagonal run skipping.

Both tokenizers encode a text; a token's end is a byte offset. Where a token of
each ends, a group ends. Most groups are one token each, so at the current index
shift the end arrays are equal over long stretches: windows of doubling size are
compared as wholes, an equal one is jumped, an unequal one halved down to its first
difference. There the irregular group is resolved by a merge of the two arrays up
to the next common end, and the shift becomes the difference of the indices.

Corpus counts of linked id pairs: tasks count pairs in bounded tables, Spark sums
them. The most frequent pairs (``HEAD``, a bounded number) are sent to the tasks,
which look their documents' pairs up; pairs beyond are joined.

Defined cases: null and empty texts, and texts whose tokens do not spell the text
(normalised characters), have no tokens: zeros and ''. Special strings in a text
are text. Very long texts are aligned whole. A null id and repeated rows are kept,
each repeat counting as links of its own; ties for the highest count are all best;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches, store

#: Pairs sent to the tasks, 24 bytes each; rarer ones are joined.
HEAD = 1 << 20
#: Pairs a task counts before it passes its table on.
TASK_PAIRS = 1 << 18
FIRST_WINDOW = 16
BLOCK = 1 << 14  # groups whose text is made at once
_COMMA, _BAR, _SEMICOLON = (np.uint64(ord(sign) << 56) for sign in ",|;")

_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                  ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])
_ROW_SQL = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary, pair long, n long"


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in the end arrays ``a`` and ``b`` (both increasing, equal at the last) at which groups end."""
    i, j, na, nb = 0, 0, len(a), len(b)
    la, lb = a.tolist(), b.tolist()
    raw_a, raw_b = a.astype("<i8").tobytes(), b.astype("<i8").tobytes()  # windows are compared as bytes
    stretches: list[tuple[int, int, int]] = []  # (first index in a, shift, length)
    while i < na:
        first = i
        short = min(i + FIRST_WINDOW // 2, na, nb - j + i)
        while i < short and la[i] == lb[j]:  # a stretch of common ends, at shift j - i
            i += 1
            j += 1
        if i == short:
            width, doubling = FIRST_WINDOW, True
            while width and i < na:
                window = raw_a[8 * i:8 * (i + width)]
                if window == raw_b[8 * j:8 * (j + width)]:
                    i, j = i + len(window) // 8, j + len(window) // 8
                else:
                    doubling = False
                width = width * 2 if doubling else width // 2
        if i > first:
            stretches.append((first, j - i, i - first))
        if i < na:  # an irregular group: to the next common end, which begins the next stretch
            x, y = la[i], lb[j]
            while x != y:
                if x < y:
                    i += 1
                    x = la[i]
                else:
                    j += 1
                    y = lb[j]
    start, shift, length = np.array(stretches, np.int64).reshape(-1, 3).T
    before = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(start - before, length)
    return at, at + np.repeat(shift, length)


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary."""
    import json
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in letters]
    byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = [b""] * (1 + max(vocab.values()))
    for piece, k in vocab.items():
        out[k] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of every piece of a sentence-piece model."""
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        out.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """text -> (ids of A, ids of B, group ends in A, group ends in B), or None."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.whole_a = Tokenizer.from_file(a_path)
        self.whole_a.encode_special_tokens = True
        self.special_a = [t.content for t in self.whole_a.get_added_tokens_decoder().values()]
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a, self.bytes_b = byte_level_bytes(a_path), piece_bytes(self.model_b)
        self.len_a, self.len_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        ranks = {piece: k for k, piece in enumerate(self.bytes_a) if piece.decode(errors="replace") not in self.special_a}
        self.encode_a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        # the digits of every id in eight bytes, of which the last is left for the sign that follows it
        self.decimal = np.array([str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))], "S8").view("<u8")

    def ids_a(self, text: str) -> np.ndarray | None:
        ids = None
        if not any(s in text for s in self.special_a):  # special strings are text
            try:
                ids = self.encode_a(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # a run of blanks too long for the pattern's stack
                pass
        if ids is None:
            ids = np.array(self.whole_a.encode(text, add_special_tokens=False).ids, np.int64)
        if self.whole_a.normalizer is None:  # byte-level tokens spell any text
            return ids
        return ids if b"".join(map(self.bytes_a.__getitem__, ids.tolist())) == text.encode() else None

    def ids_b(self, text: str) -> np.ndarray | None:
        ids = self.model_b.encode(text)
        return np.array(ids, np.int64) if b"".join(map(self.bytes_b.__getitem__, ids)) == b" " + text.encode() else None

    def align(self, text: str | None) -> tuple | None:
        if not text:
            return None
        b = self.ids_b(text)
        a = None if b is None else self.ids_a(" " + text)
        if a is None:
            return None
        return a, b, *groups(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))

    def digest(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray) -> str:
        """SHA-256 of `a1,a2|b1;a3|b2,b3`: the text is made in blocks of groups, every id
        and the sign after it in a cell of eight bytes, from which the zeros are then taken out."""
        out = hashlib.sha256()
        i = j = 0
        for k in range(0, len(at), BLOCK):
            last_a, last_b = at[k:k + BLOCK] - i, bt[k:k + BLOCK] - j
            n_a, n_b = int(last_a[-1]) + 1, int(last_b[-1]) + 1
            of_a, of_b = self.decimal[a[i:i + n_a]] | _COMMA, self.decimal[b[j:j + n_b]] | _COMMA
            of_a[last_a] ^= _COMMA ^ _BAR
            of_b[last_b] ^= _COMMA ^ _SEMICOLON
            size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            cells = np.empty(n_a + n_b, "<u8")
            cells[np.arange(n_a) + np.repeat(last_b + 1 - size_b, size_a)] = of_a  # after the B ids of the groups before
            cells[np.arange(n_b) + np.repeat(last_a + 1, size_b)] = of_b           # after the A ids up to its own group
            text = cells.tobytes().translate(None, b"\0")
            out.update(text if k + BLOCK < len(at) else text[:-1])
            i, j = i + n_a, j + n_b
        return out.hexdigest()


def _aligned(rows: DataFrame, a_path: str, b_path: str, task_pairs: int) -> DataFrame:
    """A row per text, with its linked pairs (a << 20 | b) and how often each, and
    rows of pair counts (doc fields null) whenever the task's table is full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of numbers by the million and no cycles: the collector would only walk them
        aligner = Aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        counts: Counter = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            k = len(counts)
            if k:
                yield pa.RecordBatch.from_arrays([pa.nulls(k, f.type) for f in list(_ROW)[:8]] + [pa.array(list(counts), pa.int64()),
                                                 pa.array(list(counts.values()), pa.int64())], schema=_ROW)
            counts.clear()
        try:
            for b in small_batches(batches, 1 << 20):
                out = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    got = aligner.align(text)
                    if got is None:
                        out.append((row, doc_id, 0, 0, 0, "", b"", b""))
                    else:
                        ids_a, ids_b, at, bt = got
                        pairs, times = np.unique(ids_a[at] << 20 | ids_b[bt], return_counts=True)
                        out.append((row, doc_id, len(ids_a), len(ids_b), len(at), aligner.digest(*got), pairs.astype("<i8").tobytes(), times.astype("<u4").tobytes()))
                        for p, n in zip(pairs.tolist(), times.tolist()):
                            counts[p] += n
                        if len(counts) > task_pairs:
                            yield from counted()
                    row += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)] + [pa.nulls(len(out), pa.int64())] * 2, schema=_ROW)
            yield from counted()
        finally:
            gc.enable()  # the worker serves other tasks after this one
    return rows.mapInArrow(run, _ROW_SQL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links corpus-wide), best (no id of A is linked with its B id more often)."""
    counts = aligned.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    by_b = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)))
    most = by_b.groupBy("b").agg(F.max("n").alias("most"))  # at most one row an id of B
    return by_b.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(texts: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """n_links, n_best, count_sum over the pairs of the head, and the rest to ask for."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for b in batches:
            pairs, times = (np.frombuffer(b"".join(b.column(k).to_pylist()), t) for k, t in ((6, "<i8"), (7, "<u4")))
            size = np.array([len(x) // 4 for x in b.column(7).to_pylist()], np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            links = [np.zeros(len(size), np.int64) for _ in range(3)]
            np.add.at(links[0], owner, times.astype(np.int64))
            np.add.at(links[1], owner[hit], np.where(best[at[hit]], times[hit], 0).astype(np.int64))
            np.add.at(links[2], owner[hit], times[hit].astype(np.int64) * n[at[hit]])
            miss = np.flatnonzero(~hit)
            per = np.bincount(owner[miss], minlength=len(size))
            offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pairs[miss], pa.int64()), pa.array(times[miss].astype(np.int64))], names=["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *[pa.array(x) for x in links], rest],
                                             names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "rest"])
    return texts.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long, "
                                 "rest array<struct<pair long, times long>>")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD,
              task_pairs: int = TASK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per input row."""
    aligned = store(_aligned(id_text(docs, id_col, text_col), a_path, b_path, task_pairs), "align-texts")
    counts = store(pair_counts(aligned), "align-pairs")
    total = counts.count()
    first = counts if total <= head_size else counts.orderBy(F.desc("n"), "pair").limit(head_size)
    rows = first.toPandas()  # at most head_size rows
    order = np.argsort(rows["pair"].to_numpy(np.int64))
    head = tuple(rows[c].to_numpy(t)[order] for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool)))
    scored = _scored(aligned.where("pair is null").drop("pair", "n"), head)
    if total <= head_size:
        return scored.select(COLUMNS)
    scored = store(scored, "align-scored")
    asked = scored.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    rarer = counts.where(F.col("n") <= int(head[1].min()))
    more = asked.join(rarer, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                                       F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return scored.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
