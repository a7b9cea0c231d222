import hashlib
import random
import re

import pytest

from tidemark.llm import exact_dedup as X


def plain(docs):
    groups = {}
    for k, (i, text) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, k))
    out = []
    for body, rows in groups.items():
        keep = min(rows)
        for r in rows:
            out.append((docs[r[3]][0], docs[keep[3]][0], len(rows), r is keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    bodies = ["".join(rng.choice("ab \n\té漢") for _ in range(rng.randint(0, 12))) for _ in range(150)]
    out = [(k, rng.choice(bodies)) for k in range(600)]
    out += [(1000 + k, "hot" + " " * (k % 7) + "text") for k in range(500)]  # nearly half of the rows
    out += [(2000, "long " * 30_000), (2001, "long" * 30_000), (2002, "long" * 30_000 + "x"), (None, "hottext       "), (5, out[5][1])]
    return out


@pytest.mark.parametrize("kw", [{}, {"bucket_bytes": 300, "run_bytes": 2000}, {"key_bits": 4}, {"key_bits": 1, "bucket_bytes": 300, "run_bytes": 3000},
                                {"bucket_bytes": 64, "run_bytes": 1, "slices": 3}])
def test_against_plain(make_docs, edge_rows, docs, kw):
    """Split buckets, chained collisions, a key that overflows its bucket."""
    rows = docs + [(r[0], r[1]) for r in edge_rows]
    assert rows_of(X.exact_groups(make_docs(rows).repartition(3), **kw)) == plain(rows)


def test_empty_table(make_docs):
    assert X.exact_groups(make_docs([])).collect() == []


def test_directory_doubles_and_splits(spark):
    d = X.Directory()
    d.split({0})
    assert d.depth == 1 and d.buckets == [(0, 1), (1, 1)]
    d.split({1})
    assert d.depth == 2 and d.slots().tolist() == [0, 0, 1, 2]
    keys = [(k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for k in range(2000)]
    entries = spark.createDataFrame([(k, b"x" * 10) for k in keys], "key long, body binary")
    d = X.build_directory(entries, 500)
    found = {}
    for r in d.locate(entries).collect():
        found.setdefault(r["bucket"], []).append(r["key"] % 2**64)
    assert sum(map(len, found.values())) == 2000 and max(map(len, found.values())) <= 51
    for b, ks in found.items():
        prefix, local = d.buckets[b]
        assert {k >> (64 - local) for k in ks} == {prefix}
