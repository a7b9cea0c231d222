import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, queries, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[q] = [(float(d[k]), int(ids[k])) for k in np.lexsort((ids, d)) if ids[k] != q][:top]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    left, right = rng.random(9), rng.random(7)
    cells = rng.integers(0, 3, (9, 7))
    got = ann.walk(left, right, cells, 10**9)
    want = sorted(((left[i] + right[j], i, j) for i in range(9) for j in range(7) if cells[i, j]))
    assert [left[i] + right[j] for i, j in got] == pytest.approx([w[0] for w in want]) and len(set(got)) == len(want)
    short = ann.walk(left, right, cells, 5)
    assert short == got[:len(short)] and sum(cells[c] for c in short) >= 5


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = answers(ann.search(df, F.col("vec_id") % 100 == 0))
    want = exact(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert got.keys() == want.keys()
    found = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert found >= 0.9 * sum(len(w) for w in want.values())


def test_clustered_vectors_copies_and_small_blocks(spark, monkeypatch):
    """A third of the rows are copies of one vector; blocks and turns are tiny."""
    monkeypatch.setattr(ann, "ENTRIES", 50)
    monkeypatch.setattr(ann, "QUERIES", 2)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 600)] + 0.1 * rng.normal(size=(600, 8))).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as key", "2 as v", "3 as ids")
    got, want = answers(ann.search(df, F.col("vec_id") % 20 == 0)), exact(rows, range(0, 600, 20), 10)
    assert got.keys() == want.keys()
    for q in range(0, 600, 60):  # copies: ties go to the smaller ids, without the query's own
        assert [v for _, v in got[q]] == [v for _, v in want[q]]
    found = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    assert all(s == pytest.approx(dict((v, d) for d, v in exact(rows, [q], 600)[q])[i], abs=1e-12) for q in (20, 40) for s, i in got[q])


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1),
            (5, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0], 1), (7, [], 1), (8, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (200, None, 1)]
    got = answers(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0))
    assert {q: [v for _, v in a] for q, a in got.items()} == {0: [8, 100], 100: [8, 0]}
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
