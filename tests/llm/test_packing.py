import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_matches_tokenizer(plain):
    encode = P.encoder(PATH, cache_entries=500)
    rng = random.Random(5)
    signs = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　abZé1２²'s 'll,.!?)漢字ªµß😀​_\x00"
    texts = ["", " ", "\n\n", "a  b", "a \n b ", "don't WON'T we'll", "<|endoftext|>", "x<|endoftext|> y", "ſtraße, naïve; (ok)."]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain(t), repr(t)


def test_cuts_and_powers():
    for n in [*range(1, 300), 2047, 2048, 2049, 4096, 100_001]:
        assert sum(P.cuts(n)) == n == sum(P.powers(n)) and max(P.cuts(n)) <= 2048


def check(rows, docs, plain):
    """Every id lies in one piece, sequences are gapless and padding is small."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for doc, text in docs:
        ids = np.array((plain(text) if text else []) + [1], dtype="<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[doc]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start:start + length].tobytes())
            at += length
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert padding <= 0.01 * total
    return padding, total


def test_whole_table(spark, plain):
    from tests.conftest import SF0001
    df = spark.read.parquet(f"{SF0001}/documents.parquet").repartition(3)
    check(P.pack(df, PATH).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], plain)


def test_edge_rows(make_docs, edge_rows, plain):
    rows = [r for i, r in enumerate(edge_rows) if i not in (3, 5)]  # without the null and the repeated id, which the check goes by
    check(P.pack(make_docs(rows), PATH).collect(), [(r[0], r[1]) for r in rows], plain)
    whole = P.pack(make_docs(edge_rows), PATH).collect()
    assert sum(r["length"] for r in whole) == sum(len(plain(r[1]) if r[1] else []) + 1 for r in edge_rows)
    assert P.pack(make_docs([]), PATH).count() == 0


def test_classes_take_a_fixed_count():
    packer = P.Packer(0)
    for k in range(9):
        packer.add(k, b"\0\0\0\0" * 700)  # 512 + 128 + a tail of 60
    full = defaultdict(list)
    for r in packer.rows:
        full[r[5]].append(r[2])
    assert sorted(full.values()) == [[512] * 4, [512] * 4]
    packer.finish()
    assert sum(r[2] for r in packer.rows) == 9 * 700


def test_long_runs_of_one_sign(plain):
    encode = P.encoder(PATH)
    for text in (" " * 700_000, "a " + "\n" * 700_000 + "b", "^" * 300_000, "é" * 100_000 + " x"):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text)
