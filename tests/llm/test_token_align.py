import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF0001
from tidemark.llm import token_align as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_ids():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    names = {k: p for p, k in json.load(open(A_PATH, encoding="utf-8"))["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)

    def spelt_a(k):
        out = bytearray()
        for c in names[k]:
            if 33 <= ord(c) <= 126 or 161 <= ord(c) <= 255 and ord(c) != 173:
                out.append(ord(c))
            else:
                out.append([*range(33), *range(127, 161), 173][ord(c) - 256])
        return bytes(out)

    def spelt_b(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()
    return lambda t: [(k, spelt_a(k)) for k in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(k, spelt_b(k)) for k in b.encode(t)]


def plain(docs, plain_ids):
    found, counts = [], Counter()
    for doc, text in docs:
        a, b = plain_ids[0](text or ""), plain_ids[1](text or "")
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append((doc, 0, 0, [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for _, x in v]).tolist() for v in (a, b))
        links = [(a[ends_a.index(e)][0], b[ends_b.index(e)][0]) for e in sorted(set(ends_a) & set(ends_b))]
        parts, low = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            parts.append("|".join(",".join(str(k) for (k, _), x in zip(v, ends) if low < x <= e) for v, ends in ((a, ends_a), (b, ends_b))))
            low = e
        counts.update(links)
        found.append((doc, len(a), len(b), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return sorted([(d, na, nb, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
                   for d, na, nb, links, sha in found], key=str)


def rows_of(df):
    return sorted([tuple(r[c] for c in A.COLUMNS) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    signs = " \n\t　abcZé1２²'s 'll,.!?)漢字ßµ😀▁_\x00"
    out = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    words = ["the", "Straße", "tokenization", "naïve", "un", "believable", "x1y2", "don't", "  ", "漢字", "2024-01-01", "getElementById", "<|endoftext|>", "</s>", "<0x41>", "ﬁ"]
    out += [(300 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(200)]
    return out


@pytest.mark.parametrize("kw", [{}, {"head_size": 7, "task_pairs": 5}])
def test_against_plain(make_docs, edge_rows, docs, plain_ids, kw):
    rows = docs + [(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 1000]
    got = rows_of(A.alignment(make_docs(rows), A_PATH, B_PATH, **kw))
    assert got == plain(rows, plain_ids) and sum(r[1] > 0 for r in got) > 150


def test_whole_table(spark, plain_ids):
    df = spark.read.parquet(f"{SF0001}/documents.parquet").where("length(text) < 3000")
    got = rows_of(A.alignment(df, A_PATH, B_PATH, head_size=100))
    assert got == plain([(r["doc_id"], r["text"]) for r in df.collect()], plain_ids)


def test_long_and_empty(make_docs, edge_rows):
    got = {r["doc_id"]: r for r in A.alignment(make_docs([r for r in edge_rows if r[0] == 6]), A_PATH, B_PATH).collect()}
    assert got[6]["n_groups"] > 100_000 and A.alignment(make_docs([]), A_PATH, B_PATH).collect() == []


def test_long_runs_of_one_sign():
    aligner, whole = A.Aligner(A_PATH, B_PATH), Tokenizer.from_file(A_PATH)
    for text in (" " * 700_000, "a" + "\n" * 700_000 + "b", "^" * 300_000):
        assert aligner.ids_a(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_digest_over_several_blocks():
    aligner = A.Aligner(A_PATH, B_PATH)
    rng = random.Random(4)
    text = " ".join(rng.choice(["plain", "Straße", "unbelievable", "x1y2", "漢字", "tokenization"]) for _ in range(30_000))
    a, b, at, bt = aligner.align(text)
    assert len(at) > 2 * A.BLOCK
    parts = [(a[i:x + 1], b[j:y + 1]) for i, x, j, y in zip([0, *(at[:-1] + 1)], at, [0, *(bt[:-1] + 1)], bt)]
    want = ";".join("|".join(",".join(map(str, v.tolist())) for v in p) for p in parts)
    assert aligner.digest(a, b, at, bt) == hashlib.sha256(want.encode()).hexdigest()


def test_groups_of_random_ends():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 400)
        keep = rng.choice([0.3, 0.9, 0.99])
        a, b = (np.array(sorted({x for x in range(1, n) if rng.random() < keep} | {n})) for _ in range(2))
        at, bt = A.groups(a, b)
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[at].tolist() == common == b[bt].tolist()
