import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as S
from tidemark.llm.common import table
from tidemark.llm.components import connected_components
from tests.conftest import SF0001


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(ids, fps, radius):
    label = dict(enumerate(ids))
    f = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    lab = np.arange(len(ids))
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(ids))])
        if (new == lab).all():
            break
        lab = new
    known = {}
    for i, c in enumerate(lab):
        if label[i] is not None:
            known[c] = min(known.get(c, label[i]), label[i])
    return [known.get(c) for c in lab]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c a b c d", "É é Ñ ñ x y z", "a\x0bb\x0cc d"])
def test_fingerprint_matches_plain(text):
    assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.zeros(300, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    x = np.concatenate([a, a ^ flips])
    rows, mask = S.within(x[:200], x, radius)
    got = np.zeros((200, len(x)), bool)
    got[rows] = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, :len(x)]
    assert (got == (np.bitwise_count(x[:200, None] ^ x[None, :]) <= radius)).all()


def test_links_with_small_buckets_and_split_buckets(spark, monkeypatch):
    """Buckets by several tables, and buckets compared block against block, lose no link."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 150, dtype=np.uint64)
    chain = [base]
    for _ in range(4):  # chains of 2-bit steps, so that components need more than direct links
        step = (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) | (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
        chain.append(chain[-1] ^ step)
    fps = np.unique(np.concatenate([*chain, np.arange(200, dtype=np.uint64)]))
    ids = list(range(len(fps)))
    want = plain_components(ids, fps, 3)
    for bucket, block in ((16, 4096), (100_000, 64), (64, 32)):
        monkeypatch.setattr(S, "BUCKET", bucket)
        monkeypatch.setattr(S, "BLOCK", block)
        df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
        roots = {r["node"]: r["root"] for r in connected_components(S.links(df, len(fps), 3)).collect()}
        groups = {}
        for i, f in zip(ids, fps.view(np.int64)):
            groups.setdefault(roots.get(int(f), int(f)), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert [got[i] for i in ids] == want


def test_components_of_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (None, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + k] == 1000 for k in range(1, 300)) and len(got) == 499


def test_whole_table_against_plain(spark):
    docs = table(spark, SF0001, "documents")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: ("%016x" % f, c) for r, f, c in zip(rows, fps, plain_components([r["doc_id"] for r in rows], fps, 3))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(docs).collect()}
    assert got == want


def test_edge_rows(make_docs, edge_rows):
    got = S.simhash_components(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    assert S.simhash_components(make_docs([])).count() == 0
