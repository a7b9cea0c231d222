import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie as T
from tidemark.llm.common import fold

SCHEMA = "conv_id long, turn long, role string, text string"


def lanes(role, text):
    d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return tuple(int(d[i:i + 16], 16) - (2**64 if int(d[i], 16) >= 8 else 0) for i in (0, 16))


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, lanes(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[:h[c]] + own[c][h[c]:] for c in own}


def plain(paths):
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, who in members.items():
        children = [p for p in members if len(p) == len(path) + 1 and p[:-1] == path]
        below = [p for p in members if p[:len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in below) for p in below)
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as depth", "'x' as k1", "2 as pos", "3 as base", "4 as words")
    c = F.col("conv_id")
    got = T.prefix_trie(T.rebuilt(df, c - c % 20, fold("conv_id", 4), 3), **kw)
    return sorted([(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                   for r in got.collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            out.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", None, " \t", "ü c d"])))
    out += [(100 + c, t, "user", f"line {t} of many") for c in range(40) for t in range(6 + c % 2)]  # a hot prefix
    out += [(200, t, "user", "again") for t in range(300)] + [(201, t, "user", "again" if t < 290 else "other") for t in range(300)]  # long, spans ranges
    out += [(None, 0, "user", "a"), (305, 0, None, None), (305, 0, None, None), (-7, 1, "user", "a"), out[0]]
    return out


@pytest.mark.parametrize("kw", [{}, {"stretch": 3, "batch_turns": 20}, {"stretch": 64, "batch_turns": 0}])
def test_against_plain(spark, rows, kw):
    assert found(spark, rows, **kw) == plain(plain_rebuilt(rows))


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    one = next(c for c in range(1000, 1100) if c % 20 and zlib.crc32(str(c).encode()) % 4)  # all turns replaced, no template
    assert found(spark, [(one, 0, "user", "x")]) == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


def test_local_trie_finds_exit_nodes():
    """Random strings over two letters: every prefix's members, and look-ups."""
    rng = random.Random(9)
    trie, strings = T.ZFastTrie(), []
    for c in range(400):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) if rng.random() < 0.6 or not strings else rng.choice(strings)[:rng.randint(1, 30)] + rng.choice("ab")
        strings.append(s)
        keys = [int.from_bytes(hashlib.sha256(s[:d].encode()).digest()[:8], "little", signed=True) for d in range(1, len(s) + 1)]
        trie.insert(T.Path(c, 0, np.array(keys), np.array(keys), 0, 0, np.ones(len(s), np.int64)))
        root = trie.roots[0, 0, 0]
        node, out = trie.exit(root, trie.nodes[-1].path.keys)
        assert out is None or node.end < len(trie.nodes[-1].path.keys)
    assert all(trie.handles[v.path.keys[T.fattest(v.start, v.end) - 1]] is v for v in trie.nodes) and len(trie.handles) == len(trie.nodes)
    got = {}
    for b in trie.expand():
        for r in b.to_pylist():
            assert r["k1"] not in got
            got[r["k1"]] = (r["depth"], r["n"], r["conv_id"])
    want = {}
    for c, s in enumerate(strings):
        for d in range(1, len(s) + 1):
            want.setdefault(s[:d], []).append(c)
    assert sorted(got.values()) == sorted((len(p), len(who), min(who)) for p, who in want.items())


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            assert T.fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
