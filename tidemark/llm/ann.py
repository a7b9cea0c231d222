"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised on their own, so K centroids a half
give K x K cells. A query visits cells in the order of the summed distance of
their two centroids, drawn from a heap (the multi-sequence walk), until it has
seen enough entries; the entries of those cells are reranked by exact distance
in double precision. How many are enough is measured, not guessed: for a fixed
number of trial vectors the exact neighbours are found in one pass over all
entries, and the walk's length that meets ``TARGET`` of them is used. It grows
with the table where the data have no structure.

The centroids are fitted on a bounded sample; every vector is indexed. Equal
vectors are one entry that keeps its ``top`` + 1 smallest ids, all that can be
returned for it. Entries lie in blocks of bounded size (a first-half code, dealt
on by a hash if it is large), and so do the queries that visit them.

Defined cases: vectors that are null, empty, of another length than most, zero,
or hold null or non-finite components take no part, as entries or queries;
repeated ids with the same vector are entries once; distance ties go to the
smaller id; fewer candidates than ``top`` give them all; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store

SAMPLE = 20_000        # vectors that the centroids are fitted on, about
MAX_CENTROIDS = 512    # for each half; cells are at most its square
ENTRIES = 4096         # entries in a block
QUERIES = 2048         # queries that meet a block at once
TARGET = 0.97          # recall that the number of entries to visit is set for,
TRIALS = 64            # by an exact search for about so many of the entries


@dataclass
class Codebook:
    """Centroids of both halves and the number of entries in each cell."""
    left: np.ndarray
    right: np.ndarray
    cells: np.ndarray

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _squares(x[:, :half], self.left).argmin(axis=1), _squares(x[:, half:], self.right).argmin(axis=1)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        code = np.concatenate([_squares(x[i:i + 4096], centroids).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(code, minlength=len(centroids))
        sums = np.stack([np.bincount(code, x[:, j], minlength=len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def walk(left: np.ndarray, right: np.ndarray, cells: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in order of left + right distance until ``wanted`` entries are in
    them: a heap holds the frontier of the sorted distance lists."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    frontier, met, out, seen = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while frontier and seen < wanted:
        _, i, j = heapq.heappop(frontier)
        cell = (int(a[i]), int(b[j]))
        if cells[cell]:
            out.append(cell)
            seen += int(cells[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in met:
                met.add((p, q))
                heapq.heappush(frontier, (left[a[p]] + right[b[q]], p, q))
    return out


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double): the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 1)).where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE, seed: int = 5) -> Codebook:
    """Centroids from about ``sample`` distinct vectors, drawn by a hash."""
    share = min(1.0, sample / max(n, 1))
    rows = vectors.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("v").collect()
    if not rows:  # a hash may draw nothing from a very small table
        rows = vectors.select("v").limit(sample).collect()
    x = np.array(sorted(r["v"] for r in rows), dtype=np.float64)
    k = int(min(MAX_CENTROIDS, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n / 8)))))))
    half = x.shape[1] // 2
    return Codebook(kmeans(x[:, :half], k, seed=seed), kmeans(x[:, half:], k, seed=seed + 1), np.zeros((0, 0), np.int64))


def visits(coded: DataFrame, book: Codebook, n: int, top: int, target: float, trials: int = TRIALS) -> int:
    """Entries a walk has to see so that ``target`` of the exact ``top``
    neighbours of the trial vectors are among them."""
    share = min(1.0, trials / max(n, 1))
    drawn = coded.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)).select("v").collect()
    if not drawn:
        return n
    queries = np.array(sorted(r["v"] for r in drawn), dtype=np.float64)
    sent = coded.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {}
        for b in batches:
            x = _matrix(b.column(0))
            if not len(x):
                continue
            i, j = np.asarray(b.column(1)), np.asarray(b.column(2))
            for q, v in enumerate(sent.value):
                d = ((x - v) ** 2).sum(axis=1)
                near = np.argsort(d, kind="stable")[:top + 1]
                best[q] = sorted(best.get(q, []) + [(float(d[p]), int(i[p]), int(j[p])) for p in near])[:top + 1]
        rows = [(q, *f) for q, found in best.items() for f in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int32(), pa.int32()))],
                                             names=["q", "d", "i", "j"])
    near = coded.select("v", "i", "j").mapInArrow(run, "q int, d double, i int, j int")
    near = near.withColumn("r", F.row_number().over(_by(["q"], "d", "i", "j"))).where(F.col("r") <= top + 1).collect()
    half, needed = book.left.shape[1], []
    for q, v in enumerate(queries):
        cells = [(r["i"], r["j"]) for r in near if r["q"] == q and r["r"] > 1]  # the first is the vector itself
        seen, place = 0, {}
        for cell in walk(_squares(v[None, :half], book.left)[0], _squares(v[None, half:], book.right)[0], book.cells, n):
            seen += int(book.cells[cell])
            place[cell] = seen
            if all(c in place for c in cells):
                break
        needed += [place[c] for c in cells]
    return int(np.quantile(needed, target, method="higher")) if needed else n


def search(vectors: DataFrame, query_condition, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest entries found for each
    row where ``query_condition`` (on ``vec_id``) holds, its own row aside."""
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, id_col, vector_col).withColumn("dim", F.size("v"))
    dim = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dim is None:
        return empty
    rows = rows.where(F.col("dim") == dim["dim"]).select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v")).withColumn("key", F.xxhash64("v"))
    # the smallest ids of each distinct vector; taken map-side first, so a much copied vector is no large group
    rank = F.row_number().over(_by(["key", "v"], "vec_id"))
    kept = store(rows.distinct().withColumn("r", rank).where(F.col("r") <= top + 1).drop("r"), "ann-kept")
    entries = store(kept.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    n = entries.count()
    book = fit(entries, n)
    sent = spark.sparkContext.broadcast(book)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j = sent.value.codes(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["key", "v", "ids", "i", "j"])
    coded = store(entries.select("key", "v", "ids").mapInArrow(encode, "key long, v array<double>, ids array<long>, i int, j int"), "ann-coded")
    cells = np.zeros((len(book.left), len(book.right)), dtype=np.int64)
    for r in coded.groupBy("i", "j").count().collect():  # at most MAX_CENTROIDS squared
        cells[r["i"], r["j"]] = r["count"]
    full = spark.sparkContext.broadcast(Codebook(book.left, book.right, cells))
    wanted = visits(coded, Codebook(book.left, book.right, cells), n, top, target)
    parts = -(-cells.sum(axis=1) // ENTRIES).clip(min=1)

    asked = rows.where(query_condition).select("key", "v", F.col("vec_id").alias("query_id")).distinct()
    queries = asked.groupBy("key", "v").agg(F.lit(1).alias("one")).select("key", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = full.value
        half = m.left.shape[1]
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            left, right = _squares(x[:, :half], m.left), _squares(x[:, half:], m.right)
            at, codes, lists = [], [], []
            for q in range(len(x)):
                by_left: dict[int, list[int]] = {}
                for i, j in walk(left[q], right[q], m.cells, wanted):
                    by_left.setdefault(i, []).append(j)
                at += [q] * len(by_left)
                codes += list(by_left)
                lists += list(by_left.values())
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(codes, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                                             names=["key", "v", "i", "js"])
    probes = store(queries.mapInArrow(route, "key long, v array<double>, i int, js array<int>"), "ann-probes")
    met = np.zeros(len(book.left), dtype=np.int64)
    for r in probes.groupBy("i").count().collect():
        met[r["i"]] = r["count"]
    turns = -(-met // QUERIES).clip(min=1)
    deal = spark.createDataFrame([(k, int(parts[k]), int(turns[k])) for k in range(len(parts))], "i int, parts int, turns int")

    def numbered(n_col: str):
        return F.explode(F.sequence(F.lit(0), F.col(n_col) - 1))
    held = (coded.join(F.broadcast(deal), "i").withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int"))
            .withColumn("turn", numbered("turns")).select("i", "part", "turn", "j", "key", "v", "ids"))
    seeking = (probes.join(F.broadcast(deal), "i").withColumn("turn", F.pmod(F.xxhash64("key", F.lit(4)), F.col("turns")).cast("int"))
               .withColumn("part", numbered("parts")).select("i", "part", "turn", "key", "v", "js"))

    def rerank(key: tuple, qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        out_q, out_id, out_d = [], [], []
        if len(qs) and len(es):
            ex, cell = np.stack(es["v"].to_numpy()), es["j"].to_numpy()
            ids = es["ids"].to_numpy()
            for qkey, qv, js in zip(qs["key"].to_numpy(), qs["v"], qs["js"]):
                near = np.flatnonzero(np.isin(cell, js))
                if not len(near):
                    continue
                d = np.sqrt(((ex[near] - np.asarray(qv)) ** 2).sum(axis=1))
                best = np.flatnonzero(d <= np.partition(d, min(top, len(d) - 1))[min(top, len(d) - 1)])  # ties kept for the id order
                found = sorted((d[p], int(v)) for p in best for v in ids[near[p]])[:top + 1]
                out_q += [qkey] * len(found)
                out_id += [v for _, v in found]
                out_d += [x for x, _ in found]
        return pd.DataFrame({"key": np.array(out_q, np.int64), "vec_id": np.array(out_id, np.int64), "score": np.array(out_d, np.float64)})
    found = (seeking.groupBy("i", "part", "turn").cogroup(held.groupBy("i", "part", "turn"))
             .applyInPandas(rerank, "key long, vec_id long, score double"))
    best = found.withColumn("r", F.row_number().over(_by(["key"], "score", "vec_id"))).where(F.col("r") <= top + 1)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # top + 1 at most
    answers = asked.select("key", "query_id").join(lists, "key").select(
        "query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, top).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("pos", "s")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))


def _by(keys: list[str], *order: str):
    from pyspark.sql import Window
    return Window.partitionBy(*keys).orderBy(*order)
