import random
import re

import numpy as np
import pytest

from tidemark.llm import decontam as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["the", "of"] * 10 + ["É", "ünd9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 13, 20, 40])))) for i in range(25)]
    items += [(3, items[3][1]), (7, None), (8, ""), (None, "w1 w2"), (100, "the the the the the the the the the the the the the the the")]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 60)))]
        if d % 3 == 0:
            t = rng.choice(items[:25])[1].split()
            a = rng.randint(0, max(0, len(t) - 13))
            parts += [",  ".join(t[a:a + rng.randint(5, 20)]), " ".join(rng.choice(vocabulary) for _ in range(20))]
        docs.append((d, "; ".join(parts)))
    docs += [(200, "the " * 50), (201, "of the"), (None, items[5][1]), (3, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("block_words,segment_words", [(10**6, 1 << 19), (10**6, 50), (60, 200)])
def test_against_plain(spark, make_docs, edge_rows, cases, block_words, segment_words):
    docs = cases[0] + [(r[0], r[1]) for r in edge_rows]
    tests = spark.createDataFrame(cases[1], "item_id long, text string").selectExpr("*", "1 as item", "2 as hits")
    got = D.contamination(make_docs(docs), tests, block_words=block_words, segment_words=segment_words).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got], key=str) == plain(docs, cases[1])


def test_empty_tables(spark, make_docs, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(make_docs([]), none).count() == 0
    got = D.contamination(make_docs(edge_rows), none).collect()
    assert len(got) == len(edge_rows) and not any(r["contaminated"] or r["n_hit"] for r in got)


def test_proximity_finds_changed_passage(spark, make_docs):
    item = " ".join(f"term{k}" for k in range(13))
    changed = item.replace("term6", "other").replace("term9 ", "term9 extra ")
    docs = [(1, f"a b c {changed} d e"), (2, f"x {item} y"), (3, "term1 term2 term3 nothing else"), (4, None)]
    tests = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.contamination(make_docs(docs), tests, drift=2).collect()}
    assert got[1]["items"] == [] and got[1]["near_items"] == ["9"]
    assert got[2]["items"] == ["9"] and got[2]["near_items"] == ["9"]
    assert got[3]["near_items"] == [] and got[4]["near_items"] == []


def plain_near(docs, items, size=13, drift=2):
    windows = set()
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows |= {(str(item), *w[i:i + n]) for i in range(len(w) - n + 1) if w and item is not None}
    out = []
    for doc, text in docs:
        at, n = {}, len(words(text))
        for i, x in enumerate(words(text)):
            at.setdefault(x, []).append(i)
        found = set()
        for item, *terms in windows:
            if item not in found:
                starts = np.zeros(n + 2 * drift + len(terms), dtype=int)  # by start + len(terms) - 1 + drift
                for k, x in enumerate(terms):
                    hit = {p - k + d + len(terms) - 1 + drift for p in at.get(x, ()) for d in range(-drift, drift + 1)}
                    starts[list(hit)] += 1
                if starts.max() >= -(-4 * len(terms) // 5):
                    found.add(item)
        out.append((doc, sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words,segment_words", [(10**6, 1 << 19), (10**6, 50), (60, 200)])
def test_near_items_against_plain(spark, make_docs, cases, block_words, segment_words):
    """Whatever the segments are; the rarest word may be the changed one, and no match crosses documents."""
    rng = random.Random(5)
    docs = [r for r in cases[0] if r[0] is not None]
    for d in range(300, 360):
        t = words(rng.choice([x for x in cases[1][:25] if len(words(x[1])) >= 13])[1])
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice([["zz"], [], [t[k], "yy"], ["w3"], ["w29"]])
        docs.append((d, " ".join(t)))
    tests = spark.createDataFrame(cases[1], "item_id long, text string")
    got = D.contamination(make_docs(docs), tests, drift=2, block_words=block_words, segment_words=segment_words).collect()
    want = plain_near(docs, cases[1])
    assert sorted([(r["doc_id"], r["near_items"]) for r in got], key=str) == want and sum(len(n) for _, n in want) > 100


def test_query_reports_changed_passages(spark, tmp_path):
    from tidemark.llm.queries import QUERIES
    text = " ".join(f"term{k}" for k in range(40))
    changed = " ".join("other" if k % 12 == 6 else f"term{k}" for k in range(40))
    spark.createDataFrame([(1, changed), (2, text), (3, "nothing")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op5_decontamination"](spark, str(tmp_path)).collect()}
    assert [(got[k]["n_items"], got[k]["contaminated"], got[k]["n_near_items"]) for k in (1, 2, 3)] == [(0, False, 1), (1, True, 1), (0, False, 0)]


def test_window_never_crosses_documents(spark, make_docs):
    tests = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    got = D.contamination(make_docs([(1, "a b"), (2, "c d"), (3, "a b c d")], extra=False).coalesce(1), tests).collect()
    assert {r["doc_id"]: r["n_hit"] for r in got} == {1: 0, 2: 0, 3: 4}


def test_segment_bounds():
    tests = D.make_tests([(1, "a b c")], 2)
    assert [w.shape for w, _ in tests.windows] == [(2, 2)]
    assert np.array_equal(tests.windows[0][1], [0, 0])
