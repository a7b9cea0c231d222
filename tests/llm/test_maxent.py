import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import maxent as M
from tidemark.llm.common import crc_fold_py, fold, id_text, store, table
from tests.conftest import SF0001


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [M.END]


def plain(rows, learn):
    c = Counter(t for i, text in rows if learn(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("head", [100_000, 300, 0])
def test_base_scores_against_plain(spark, head):
    docs = table(spark, SF0001, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows, lambda i: crc_fold_py(i, 5) != 1)
    got = M.scores(docs, fold("doc_id", 5) != 1, head_size=head, rounds=1).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_model_beats_base_on_held_out_rows(spark):
    got = M.scores(table(spark, "/root/testdata/sf0.01", "documents"), fold("doc_id", 5) != 1).where(fold("doc_id", 5) == 1).agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_probabilities_add_up_to_one(spark, make_docs):
    """Over the frequent words, the rare ones and one unseen place, after any history."""
    rows = [(i, f"the w{i % 7} of the w{i % 50} x{i}") for i in range(120)]
    docs = id_text(make_docs(rows))
    counts = store(M.count_tokens(docs), "test-counts")
    for size in (1000, 60):
        head = M.make_head(counts, size)
        weights, bias = M.fit(docs, head, rounds=1)
        every = {r["token"]: r["c"] for r in counts.collect()}
        frequent = head.words.to_pylist()
        rare = [every[w] for w in every if w not in set(frequent)]
        inside = np.zeros(M.CLASSES)
        np.add.at(inside, head.classes, 10 ** head.inside)
        inside[-1] += sum((c + 0.5) / head.rare_total for c in [*rare, 0])
        t = M.tokens_of(pa.array(["the w3 of"]), head)
        p = np.exp(M._logits(weights, bias, t.features))
        p /= p.sum(axis=1, keepdims=True)
        used = np.isin(np.arange(M.CLASSES), [*head.classes, M.CLASSES - 1])
        assert np.allclose(inside[used], 1) and np.allclose(p.sum(axis=1), 1)


def test_every_pair_has_weights_of_its_own(spark, make_docs):
    """Pairs that share a bucket differ; scores are those of a plain count of all pairs, whatever the tasks are."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 60} x{j % 5}" for j in range(i % 40))) for i in range(90)]
    docs, learn = id_text(make_docs(rows)), F.col("doc_id") % 3 != 0
    head = M.make_head(store(M.count_tokens(docs.where(learn)), "test-counts"))
    weights, bias = M.fit(docs.where(learn), head, 1)
    place, counts, every = {w: i for i, w in enumerate(head.words.to_pylist())}, Counter(), {}
    for i, text in rows:
        t = M.tokens_of(pa.array([text]), head)
        names = ["<", "<", *tokens(text)]
        z = np.exp(M._logits(weights, bias, t.features))
        every[i] = [((a, b), M._class_of(head, np.array([place.get(w, -1)]))[0], p) for a, b, w, p in zip(names, names[1:], names[2:], z / z.sum(axis=1, keepdims=True))]
        counts.update((pair, c) for pair, c, _ in every[i] if i % 3)
    sizes = Counter()
    for (pair, _), n in counts.items():
        sizes[pair] += n
    want = {i: sum(math.log10((M.PRIOR * p[c] + counts[pair, c]) / (M.PRIOR + sizes[pair])) for pair, c, p in found) for i, found in every.items()}
    for tasks in (1, 5):
        scored = store(M._score_pairs(M._score_head(docs.withColumn("learn", learn), head, tasks * M.SHARES), weights, bias, tasks), "test-scored")
        got = scored.where("docs is null").join(M._class_sums(scored), "row").collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["class_sum"] == pytest.approx(want[r["doc_id"]], rel=1e-4)


def hot_rows():
    """One pair before every text, a phrase in most texts, and texts of one word."""
    return [(i, f"w{i % 9}" if i % 2 else " ".join(["one two three"] * (i % 5) + [f"x{i % 31}", f"y{i % 7}"])) for i in range(400)]


def test_heavy_pairs_are_counted_by_class(spark, make_docs):
    docs, share = id_text(make_docs(hot_rows())), 0.01
    every = store(M.count_all(docs, share), "test-counts")
    head = M.make_head(M.only_tokens(every))
    heavy = M.make_heavy(every, head.tokens, share)
    M.fit(docs, head, 2, heavy=heavy)
    place, counts = {w: i for i, w in enumerate(head.words.to_pylist())}, Counter()
    for _, text in hot_rows():
        names = ["<", "<", *tokens(text)]
        counts.update(((a, b), int(head.classes[place[w]])) for a, b, w in zip(names, names[1:], names[2:]))
    sizes = Counter()
    for (pair, _), n in counts.items():
        sizes[pair] += n
    name = lambda w: 1 if w == "<" else int(M._names(pa.array([w]))[0])
    hashes = {int(M._hash(1, np.array([name(b)]), np.array([name(a)]))[0]): (a, b) for a, b in sizes}
    assert 3 <= len(heavy.pairs) <= 1 / share and {p for p, n in sizes.items() if n >= 2 * share * head.tokens} <= {hashes[p] for p in heavy.pairs.tolist()}
    for p, row in zip(heavy.pairs.tolist(), heavy.counts):
        assert {c: n for c, n in enumerate(row.tolist()) if n} == {c: n for (pair, c), n in counts.items() if pair == hashes[p]}


def test_scores_do_not_depend_on_what_is_heavy(spark, make_docs):
    """Whole scores equal a plain sum over all tokens of class and word parts, by either way of a pair."""
    rows = hot_rows()
    docs, learn = id_text(make_docs(rows)), F.col("doc_id") % 3 != 0
    every = store(M.count_all(docs.where(learn), 0.01), "test-counts")
    head = M.make_head(M.only_tokens(every))
    heavy = M.make_heavy(every, head.tokens, 0.01)
    weights, bias = M.fit(docs.where(learn), head, 1, heavy=heavy)
    place, counts, sizes, every = {w: i for i, w in enumerate(head.words.to_pylist())}, Counter(), Counter(), {}
    unseen = math.log10(0.5 / head.rare_total)
    for i, text in rows:
        t = M.tokens_of(pa.array([text]), head)
        names = ["<", "<", *tokens(text)]
        z = np.exp(M._logits(weights, bias, t.features))
        every[i] = [((a, b), int(head.classes[place[w]]) if w in place else M.CLASSES - 1, place.get(w), p)
                    for a, b, w, p in zip(names, names[1:], names[2:], z / z.sum(axis=1, keepdims=True))]
        if i % 3:
            counts.update((pair, c) for pair, c, _, _ in every[i])
            sizes.update(pair for pair, *_ in every[i])
    want = {i: sum(math.log10((M.PRIOR * p[c] + counts[pair, c]) / (M.PRIOR + sizes[pair])) + (unseen if w is None else head.inside[w]) for pair, c, w, p in found)
            for i, found in every.items()}
    marked, most = docs.withColumn("learn", learn), []
    for hot in (heavy, None):
        dealt = store(M._score_head(marked, head, 16, hot, (weights, bias)), "test-dealt")
        most.append(max([r[0] for r in dealt.where("docs is not null").groupBy("shard").agg(F.sum(F.length("high"))).select("sum(length(high))").collect()], default=0))
        scored = store(M._score_pairs(dealt, weights, bias, 2), "test-scored")
        got = scored.where("docs is null").join(M._class_sums(scored), "row", "left").collect()
        assert len(got) == len(rows)
        for r in got:
            rare = sum(x["n"] for x in r["rare"])
            assert r["model"] + (r["class_sum"] or 0.0) + rare * unseen == pytest.approx(want[r["doc_id"]], rel=1e-4)
    assert most[0] * 4 < most[1]  # no shard is hot for a pair that all texts share


def test_rounds_follow_the_learning_tokens():
    assert [M.rounds_for(n) for n in (0, 1 << 24, 1 << 27, 1 << 33)] == [2, 2, 4, 10]


def test_trainers_of_a_round_are_bounded():
    assert [M.trainers_for(n, r, 8) for n, r in ((0, 2), (1 << 24, 2), (1 << 30, 7), (1 << 44, 21))] == [8, 8, 36, 4096]


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(0, .1, (M.KINDS * M.BUCKETS, M.CLASSES)).astype(np.float32), np.zeros(M.CLASSES, np.float32)
    f = np.stack([rng.integers(0, 5, 40) + k * M.BUCKETS for k in range(M.KINDS)], axis=1)
    y = rng.integers(0, M.CLASSES, 40)

    def loss(w):
        z = M._logits(w, bias, f).astype(np.float64)
        return -(z[np.arange(40), y] - np.log(np.exp(z).sum(axis=1))).sum()
    before = loss(weights)
    M.gradient_steps(weights, bias, np.ones(len(weights), np.float32), f, y, 0.05)
    assert loss(weights) < before


def test_edge_rows(make_docs, edge_rows):
    got = M.scores(make_docs(edge_rows), F.col("doc_id") != 7).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[6]["n_tokens"] == 120_001
    assert by[7]["n_known"] == 1 and all(math.isfinite(r["score"]) for r in got)
    nothing = M.scores(make_docs(edge_rows), F.lit(False)).collect()
    assert len(nothing) == len(edge_rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["base_score"]) for r in nothing)
    assert M.scores(make_docs([])).count() == 0
