import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import wordpiece as W

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces):
    w, i, n = [*word[:-1], word[-1] + 256], 0, 0
    while i < len(w):
        size = next((k for k in range(len(w) - i, 0, -1) if tuple(w[i:i + k]) in pieces), 0)
        if not size:
            return 0
        i, n = i + size, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), st.booleans()), max_size=14),
       st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=8))
def test_automaton_is_greedy_longest_match(pieces, words):
    a = W.Automaton([(tuple(p), e) for p, e in pieces])
    known = {(*p[:-1], p[-1] + 256 * e) for p, e in pieces}
    assert [a.count(w) for w in words] == [greedy(w, known) for w in words]


def test_counts_against_plain(spark, make_docs, edge_rows):
    known = {(*p[:-1], p[-1] + 256 * e) for p, e in W.read_vocabulary(PATH)}
    rng = random.Random(1)
    rows = edge_rows[:5] + edge_rows[8:] + [(20 + k, "".join(rng.choice("abcdeé １9.-_漢ß ") for _ in range(200)), "en", "a") for k in range(20)]
    got = {(r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in W.token_counts(make_docs(rows), PATH).collect()}
    want = set()
    for i, text, *_ in rows:
        n = [greedy(w.encode(), known) for w in W.WORD.findall((text or "").lower())]
        want.add((i, len(n), sum(max(1, k) for k in n), n.count(0)))
    assert got == want
    assert W.token_counts(make_docs(edge_rows), PATH).count() == len(edge_rows)
    assert W.token_counts(make_docs([]), PATH).count() == 0


def test_word_that_cannot_be_spelled():
    a = W.Automaton([((97,), False), ((97,), True), ((97, 98), False)])
    assert a.count(b"aa") == 2 and a.count(b"ab") == 0 and a.count(b"aba") == 2 and W.Automaton([]).count(b"a") == 0
