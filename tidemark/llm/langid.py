"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte n-grams (of letter runs,
with their borders), followed by a linear softmax. The model is fitted on the
driver by stochastic gradient descent in numpy, on a bounded sample of labelled
texts; its size does not grow with the corpus. A held-out part of the sample
sets the temperature (calibration) and the probability under which a prediction
is rejected. Since the mean and the linear layer commute, scoring looks up one
row of class scores per n-gram, for each distinct word of a batch once.

Defined cases: a null text or one without a letter is 'und' with score 0 and
rejected; very long texts are read whole; ties go to the first language in
sorted order; repeated rows get a row each; without any labelled row every text
is 'und'; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches

BUCKETS = 1 << 17
DIM = 16
SIZES = (2, 3, 4, 5, 6)
SAMPLE_PER_LANG = 1000    # bound of the training sample, for each language
SNIPPET_WORDS = 80       # a training stretch has fewer words than this
SNIPPETS = 4
EPOCHS = 3
UNDETERMINED = "und"

#: Bytes of letter runs stay (lower-cased before), all other ASCII becomes a border.
LETTER_BYTES = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def ngrams(buffer: np.ndarray, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all letter runs in ``buffer`` (bytes, borders are 32):
    (position of the first byte, bucket). An n-gram may begin and end with a
    border but has none inside."""
    at, where = [], []
    for n in sizes:
        m = len(buffer) - n + 1
        if m <= 0:
            continue
        code, inner, letters = np.zeros(m, dtype=np.uint64), np.ones(m, dtype=bool), np.zeros(m, dtype=np.int8)
        for k in range(n):
            part = buffer[k:k + m]
            code = code * np.uint64(257) + part
            letters += part != 32
            if 0 < k < n - 1:
                inner &= part != 32
        good = np.flatnonzero(inner & (letters >= max(1, n - 2)))
        mixed = (code[good] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        at.append(good)
        where.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
    return (np.concatenate(at), np.concatenate(where)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray      # bucket -> class scores (embedding times linear layer)
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _letters_only(text: str) -> np.ndarray:
    return LETTER_BYTES[np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8)]


def _snippets(text: str, seed: int) -> list[np.ndarray]:
    """Stretches of the text of a few to many words, drawn from its whole length, as bucket arrays."""
    words = text.split()
    rng = np.random.default_rng(seed)
    found = []
    for size in rng.integers(4, SNIPPET_WORDS, SNIPPETS):
        i = rng.integers(0, max(1, len(words) - size + 1))
        found.append(ngrams(_letters_only(" ".join(words[i:i + size])))[1].astype(np.int32))
    return [f for f in found if len(f)]


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = EPOCHS, rate: float = 0.5) -> Model:
    """Fit on (text, lang) rows; one in five is held out to calibrate."""
    langs = sorted({lang for _, lang in rows})
    number = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    linear, bias = np.zeros((DIM, len(langs)), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    linear += rng.normal(0, 0.1, linear.shape).astype(np.float32)
    train, held = [], []
    for i in rng.permutation(len(rows)):
        text, lang = rows[i]
        (held if i % 5 == 0 and len(rows) >= 50 else train).extend((f, number[lang]) for f in _snippets(text, int(i)))
    steps, step = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            found, y = train[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = embed[found].mean(axis=0)
            z = mean @ linear + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = (linear @ p) * (lr * 50 / len(found))
            linear -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            rows_hit, times = np.unique(found, return_counts=True)
            embed[rows_hit] -= np.minimum(times, 20)[:, None] * back
    model = Model(langs, (embed @ linear).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    check = held or train
    if check:
        sums = np.stack([model.table[f].sum(axis=0, dtype=np.float64) for f, _ in check])
        counts, truth = np.array([len(f) for f, _ in check]), np.array([y for _, y in check])
        losses = []
        for t in np.geomspace(1, 20, 40):  # never sharper than trained: a text of no learned language must stay doubtful
            model.temperature = float(t)
            q = model.probabilities(sums, counts)[np.arange(len(truth)), truth]
            losses.append((-np.log(np.maximum(q, 1e-12)).mean(), t))
        model.temperature = float(min(losses)[1])
        top = model.probabilities(sums, counts).max(axis=1)
        # rejects next to none of the texts like those learned from, however short
        model.threshold = float(min(0.5, 0.75 * np.quantile(top, 0.0005)))
    return model


def train(docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
          per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on a bounded sample of the rows where ``learn`` holds and text and
    language are known: about ``per_lang`` whole texts of each language, drawn by
    a hash of key and text."""
    known = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                        F.xxhash64(F.col(f"`{key_col}`"), F.lit(17)).alias("h"), (F.lit(True) if learn is None else learn).alias("learn"))
    known = known.where("learn and text is not null and lang is not null")
    counts = known.groupBy("lang").count()  # a row per language, all of which are learned
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count"))
    rows = known.join(counts, "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang").collect()
    return fit(sorted((r["text"], r["lang"]) for r in rows))


def _score(m: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Prediction, score and rejection of each text."""
    import pyarrow.compute as pc
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    enc = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    offsets, idx = offsets - offsets[0], np.asarray(enc.indices).astype(np.int64)
    buffer = np.frombuffer((" " + " ".join(enc.dictionary.to_pylist()) + " ").encode(), dtype=np.uint8)
    lengths = np.asarray(pc.binary_length(enc.dictionary)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])  # the blank before each distinct word
    at, where = ngrams(LETTER_BYTES[buffer])
    word = np.searchsorted(first, at, "right") - 1
    keep = word < len(lengths)
    word, where = word[keep], where[keep]
    n, classes = len(texts), len(m.langs)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc, np.bincount(word, minlength=len(lengths))[idx], minlength=n)
    letters = np.array(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist(), dtype=bool)
    known = letters & (counts > 0) & (classes > 0)
    best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
    if classes:
        sums = np.stack([np.bincount(doc, np.bincount(word, m.table[where, k], minlength=len(lengths))[idx], minlength=n)
                         for k in range(classes)], axis=1)
        p = m.probabilities(sums, counts)
        best, score = p.argmax(axis=1), p.max(axis=1)
    score = np.where(known, score, 0.0)
    return [m.langs[k] if ok else UNDETERMINED for k, ok in zip(best, known)], score, ~known | (score < m.threshold)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: a row per input row. score is the
    calibrated probability of the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2 << 20):
            names, score, rejected = _score(sent.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                                             names=["doc_id", "lang_pred", "score", "rejected"])
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2 << 20):
            yield b.filter(pa.array(~_score(sent.value, b.column(at))[2]))
    return docs.mapInArrow(run, docs.schema)
