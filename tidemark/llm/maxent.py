"""Language-model scores by a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class), a class-factored
softmax. The class softmax has a weight for each hashed feature of the history
(previous word, the two previous words, and the word before the previous one as
a skip feature) and class. Classes are the most frequent words alone, then bands
of frequency, then one for all rare and unseen words; inside a class the only
features are the words themselves, whose maximum-entropy weights are their
logged relative counts (with 1/2 added in the rare class, where unseen words
share one place).

Token counts cover all learning texts and stay distributed; only the counts of
the ``HEAD`` most frequent tokens are sent to workers, those of rarer tokens are
joined. Training is by distributed gradient steps: in each round the workers take
steps through their share of the texts and the means of their weights, by token,
become the next model; the number of rounds follows the learning tokens.

The ``BUCKETS`` hashed features of each kind are many histories' in common. Every
distinct pair of previous words has weights of its own besides: that of class c is
log(1 + n(c) / (PRIOR * q(c))), with the pair's counts n in the learning texts and
q by the hashed features, and exp of the weights is normalised by 1 + n / PRIOR
(the optimum of the pair's likelihood under a Dirichlet prior at q). These weights
stay distributed: tokens are dealt by pair, numbered and counted where they
arrive, and their scores go back to the texts. Tokens of heavy pairs (``Heavy``; the
pair before every text's first word is one) are never dealt: a first pass finds these
pairs, the training rounds count their classes beside their steps, and the counts are
sent to the tasks that read the texts. So no shard is larger for a pair that holds a
third of all tokens.

Defined cases: a null or blank text is one end token; very long texts are scored
in batches of tokens; without learning texts N = V = 0, every token is unseen and
takes the rare class; repeated rows get a row each; an empty table gives an empty
table. Ties: words of equal counts stand in the head in the words' order, and the
border of the head falls between bands of counts, so equal counts are all in or all
out. Of the input only the id and the text are read: columns of other names, whatever
they are, cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches, store, words_of_batch

HEAD = 400_000      # most frequent tokens whose counts are sent to workers (bounds the broadcast)
CLASSES = 64
BUCKETS = 1 << 13   # hashed features of each kind
KINDS = 3
BATCH = 8192        # tokens in a gradient step or scoring batch
ROUNDS = 2          # at least; and one for each doubling of the learning tokens from ROUND_TOKENS
ROUND_TOKENS = 1 << 24
PRIOR = 8.0         # strength of the hashed model against a pair's own counts
SHARES = 8          # shards of the pairs for each task
SHARD_TOKENS = 4_000_000  # tokens of the pairs that a task is meant for
RATE = 0.15
CHUNKS = 64         # pieces in which weights are averaged
TRAINERS = 4096     # tasks of a training round at most: each gives back a change of all weights
TRAINER_TOKENS = 1 << 22  # tokens that a trainer is meant for, where there are more than cores can take at once
HEAVY_SHARE = 2.0 ** -14  # a pair that holds this share of the learning tokens is heavy (bounds their number)
SLOTS = 1 << 20     # a first sieve for heavy pairs
END = ""            # no word is empty, so this stands for the end token


@dataclass
class Head:
    """The frequent tokens: words in order of count, their classes, and log10 P(word | class)."""
    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray
    inside: np.ndarray
    tokens: int          # N
    distinct: int        # V
    rare_total: float    # normaliser of the rare class
    names: np.ndarray    # what the words are to the features
    end: int = -1        # place of the end token

    @property
    def base_total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


@dataclass
class Heavy:
    """The pairs of previous words that hold a large share of the learning tokens, in order of their
    hashes, at most 1 / share of them; and their learning tokens by class, which ``fit`` counts."""
    pairs: np.ndarray
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(SLOTS, dtype=bool)
        self.sieve[(self.pairs & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def place(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens after heavy pairs, and the places of these pairs."""
        some = np.flatnonzero(self.sieve[(pair & np.uint64(SLOTS - 1)).astype(np.int64)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.pairs, pair[some]), len(self.pairs) - 1)
        same = self.pairs[at] == pair[some]
        return some[same], at[same]


def _names(words: pa.Array) -> np.ndarray:
    """What words are to the features: a hash, the same in every pass."""
    return np.array([crc32(w) for w in words.cast(pa.binary()).to_pylist()], dtype=np.int64) + 2


def _frequent_pairs(pair: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that hold ``share`` of these tokens or more, and their counts; found through their slots' counts."""
    least = max(2, int(np.ceil(share * len(pair))))
    slot = (pair & np.uint64(SLOTS - 1)).astype(np.int64)
    some = pair[np.bincount(slot, minlength=SLOTS)[slot] >= least]
    found, n = np.unique(some, return_counts=True)
    return found[n >= least], n[n >= least]


def count_all(docs: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """token, c over all rows (doc_id, text), the end token's count being that of the rows; and rows of a blank and a
    pair's hash instead of a token (no word begins with a blank), whose c is the pair's count where it is frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for b in small_batches(batches, 16 << 20):
            offsets, words, idx = words_of_batch(b.column(1))
            rows += b.num_rows
            n = np.bincount(idx, minlength=len(words))
            keep = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()).take(pa.array(keep)), pa.array(n[keep], pa.int64())], names=["token", "c"])
            _, _, one, two = _histories(offsets, _names(words)[idx] if len(words) else idx)
            pairs, n = _frequent_pairs(_hash(1, one, two), share)
            yield pa.RecordBatch.from_arrays([pa.array([f" {p:016x}" for p in pairs.tolist()], pa.string()), pa.array(n, pa.int64())], names=["token", "c"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.string()), pa.array([rows], pa.int64())], names=["token", "c"])
    return docs.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def only_tokens(counts: DataFrame) -> DataFrame:
    return counts.where(~F.col("token").startswith(" "))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all rows (doc_id, text); the end token's count is that of the rows."""
    return only_tokens(count_all(docs))


def make_heavy(counts: DataFrame, tokens: int, share: float = HEAVY_SHARE) -> Heavy:
    """The pairs whose counts in ``count_all`` reach the share: as these are parts of their counts, at most 1 / share
    pairs; and every pair of twice the share is among them, since a part leaves out no more than the share of its tokens."""
    rows = counts.where(F.col("token").startswith(" ") & (F.col("c") >= max(2.0, share * tokens))).select("token").collect()
    pairs = np.sort(np.array([int(r["token"], 16) for r in rows], dtype=np.uint64))
    return Heavy(pairs, np.zeros((len(pairs), CLASSES), dtype=np.int64))


def make_head(counts: DataFrame, size: int = HEAD, classes: int = CLASSES) -> Head:
    """Take the most frequent tokens: those above the count at which ``size`` would be passed."""
    band = F.floor(F.log2("c") * 16).cast("long")
    bands = sorted(counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect(), key=lambda r: -r["band"])
    total, distinct = sum(r["c"] for r in bands), sum(r["n"] for r in bands)
    least, taken, mass = None, 0, 0
    for r in bands:
        if taken + r["n"] > size:
            break
        least, taken, mass = r["band"], taken + r["n"], mass + r["c"]
    rows = counts.where(band >= (1 << 40 if least is None else least)).toPandas()
    rows = rows.sort_values(["c", "token"], ascending=[False, True])
    n = rows["c"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    single = min(len(n), classes * 3 // 4 - 1)
    bands_left = classes - 1 - single
    which = np.arange(len(n))
    if len(n) > single:
        rest = np.cumsum(n[single:])
        which[single:] = single + np.minimum((rest - 1) * bands_left // max(1, rest[-1]), bands_left - 1)
    mass_of = np.bincount(which, n, minlength=classes)
    inside = np.log10(n / mass_of[which]) if len(n) else np.zeros(0)
    rare_total = (total - mass) + 0.5 * (distinct - taken + 1)
    ends = np.flatnonzero(rows["token"].to_numpy() == END)
    words = pa.array(rows["token"].tolist(), pa.string())
    return Head(words, n, which, inside, int(total), int(distinct), float(rare_total), _names(words), int(ends[0]) if len(ends) else -1)


def _hash(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(parts[0].shape, 0x9E3779B97F4A7C15 * (kind + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    return (_hash(kind, *parts) % np.uint64(BUCKETS)).astype(np.int64) + kind * BUCKETS


def _histories(offsets: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words given by name: whether a token is an end, each token's text, and the names of the word before it
    and of the one before that; 1 stands before a text."""
    sizes = np.diff(offsets)
    ends = offsets[1:] + np.arange(len(sizes))
    n = int(offsets[-1]) + len(sizes)
    is_end = np.zeros(n, dtype=bool)
    is_end[ends] = True
    name = np.zeros(n, np.int64)
    name[~is_end] = names
    first = np.concatenate([[0], ends[:-1] + 1]) if len(sizes) else np.zeros(0, np.int64)
    one, two = np.concatenate([[1], name[:-1]])[:n], np.concatenate([[1, 1], name[:-2]])[:n]
    one[first] = 1
    two[first] = 1
    two[first[sizes > 0] + 1] = 1
    return is_end, np.repeat(np.arange(len(sizes)), sizes + 1), one, two


@dataclass
class Tokens:
    """Tokens of a batch of texts, each text closed by its end token."""
    doc: np.ndarray       # text number of each token
    head: np.ndarray      # place in the head, -1 if rare
    word: np.ndarray      # place in ``words``, -1 for the end
    words: pa.Array
    features: np.ndarray  # tokens x KINDS
    pair: np.ndarray      # hash of the two previous words


def tokens_of(texts: pa.Array, head: Head) -> Tokens:
    import pyarrow.compute as pc
    offsets, words, idx = words_of_batch(texts)
    words = words.cast(pa.string())
    at = np.asarray(pc.fill_null(pc.index_in(words, value_set=head.words), -1)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    names = head.names[at] if len(head.names) else at.copy()
    rare = np.flatnonzero(at < 0)
    names[rare] = _names(words.take(pa.array(rare, pa.int64())))
    is_end, doc, one, two = _histories(offsets, names[idx])
    n = len(is_end)
    word, place = np.full(n, -1, np.int64), np.full(n, head.end, np.int64)
    word[~is_end], place[~is_end] = idx, at[idx]
    pair = _hash(1, one, two)
    features = np.stack([_mix(0, one), (pair % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS, _mix(2, two)], axis=1) if n else np.zeros((0, KINDS), np.int64)
    return Tokens(doc, place, word, words, features, pair)


def _logits(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = np.take(weights, features[:, 0], axis=0)
    for k in range(1, KINDS):
        z += np.take(weights, features[:, k], axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def _class_of(head: Head, place: np.ndarray) -> np.ndarray:
    return np.where(place >= 0, head.classes[place] if len(head.classes) else CLASSES - 1, CLASSES - 1)


def _segment_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``; most runs are short."""
    sizes = np.diff(np.append(first, len(rows)))
    out = np.take(rows, first, axis=0)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        out[more] += np.take(rows, first[more] + k, axis=0)
    for j in np.flatnonzero(sizes > 4).tolist():
        i = first[j] + 4
        out[j] += np.ones(sizes[j] - 4, rows.dtype) @ rows[i:i + sizes[j] - 4]
    return out


def gradient_steps(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, features: np.ndarray, target: np.ndarray, rate: float) -> None:
    """Steps through the tokens in batches; the step of a feature shrinks with its gathered squared gradient."""
    for i in range(0, len(target), BATCH):
        f, y = features[i:i + BATCH], target[i:i + BATCH]
        p = _logits(weights, bias, f)
        np.exp(p, out=p)
        p /= (p @ np.ones(CLASSES, p.dtype))[:, None]
        p[np.arange(len(y)), y] -= 1
        for k in range(KINDS):
            order = np.argsort(f[:, k].astype(np.uint16), kind="stable")  # a radix sort; a kind's buckets fit 16 bits
            placed = f[order, k]
            first = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
            rows = placed[first]
            slope = _segment_sums(np.take(p, order, axis=0), first)
            squares[rows] += np.einsum("ij,ij->i", slope, slope) / CLASSES
            weights[rows] -= (rate / np.sqrt(1e-6 + squares[rows]))[:, None] * slope


def rounds_for(tokens: int) -> int:
    return max(ROUNDS, (tokens // ROUND_TOKENS).bit_length())


def trainers_for(tokens: int, rounds: int, cores: int) -> int:
    return min(TRAINERS, max(cores, tokens // (rounds * TRAINER_TOKENS)))


def fit(docs: DataFrame, head: Head, rounds: int = ROUNDS, rate: float = RATE, heavy: Heavy | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class weights (KINDS x BUCKETS rows) and bias, from all rows (doc_id, text). Every row is in one round; so the
    rounds together count the tokens after ``heavy`` pairs, if given, by class."""
    spark = docs.sparkSession
    mass = np.bincount(head.classes, head.counts, minlength=CLASSES) if len(head.counts) else np.zeros(CLASSES)
    mass[CLASSES - 1] += max(0.0, head.tokens - mass.sum())
    bias = np.log((mass + 0.5) / (mass.sum() + 0.5 * CLASSES)).astype(np.float32)
    weights = np.zeros((KINDS * BUCKETS, CLASSES), dtype=np.float32)
    trainers = trainers_for(head.tokens, rounds, spark.sparkContext.defaultParallelism)
    sent_head = spark.sparkContext.broadcast((head, Heavy(heavy.pairs, heavy.counts[:0]) if heavy is not None and len(heavy.pairs) else None))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((weights, bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (start, b0), (h, hot) = sent.value, sent_head.value
            own, squares, seen = start.copy(), np.ones(len(start), dtype=np.float32), 0
            after = np.zeros(len(hot.pairs) * CLASSES if hot else 0, dtype=np.int64)
            for b in small_batches(batches, 4 << 20):
                t = tokens_of(b.column(1), h)
                target = _class_of(h, t.head)
                gradient_steps(own, b0, squares, t.features, target, rate)
                seen += len(t.doc)
                if hot:
                    which, at = hot.place(t.pair)
                    after += np.bincount(at * CLASSES + target[which], minlength=len(after))
            if seen:
                change = (own - start).astype(np.float16)
                cells = [c.tobytes() for c in np.split(change, CHUNKS)] + [c.tobytes() for c in np.array_split(after, CHUNKS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(2 * CHUNKS), pa.int32()), pa.array([seen] * (2 * CHUNKS), pa.int64()), pa.array(cells, pa.binary())],
                                                 names=["chunk", "seen", "change"])

        def mean(key: tuple, group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n, counted = 0, 0, key[0] >= CHUNKS
            for part in group:
                for seen, cell in zip(part["seen"], part["change"]):
                    total = total + (np.frombuffer(cell, np.int64) if counted else seen * np.frombuffer(cell, np.float16).astype(np.float64))
                    n += seen
            yield pd.DataFrame({"chunk": [key[0]], "change": [(total if counted else (total / max(n, 1)).astype(np.float32)).tobytes()]})

        share = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)) == r) if rounds > 1 else docs
        moved = share.coalesce(trainers).mapInArrow(run, "chunk int, seen long, change binary").groupBy("chunk").applyInPandas(mean, "chunk int, change binary").collect()
        if moved:
            cells = [m["change"] for m in sorted(moved, key=lambda m: m["chunk"])]
            weights = weights + np.concatenate([np.frombuffer(c, np.float32).reshape(-1, CLASSES) for c in cells[:CHUNKS]])
            if heavy is not None and len(heavy.pairs):
                heavy.counts += np.concatenate([np.frombuffer(c, np.int64) for c in cells[CHUNKS:]]).reshape(-1, CLASSES)
    return weights, bias


RARE = "array<struct<token:string,n:long>>"
_RARE_TYPE = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))


def heavy_scores(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log10 P(class | history) of every class after pairs of the given features and class counts."""
    z = np.exp(_logits(weights, bias, features).astype(np.float64))
    q = np.maximum(z / z.sum(axis=1, keepdims=True), 1e-30)
    return np.log10(q + counts / prior) - np.log10(1 + counts.sum(axis=1, keepdims=True) / prior)


def _score_head(docs: DataFrame, head: Head, shards: int, heavy: Heavy | None = None, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A row per text: its sums over frequent tokens, and its rare tokens with their numbers; and a row per part of a
    batch and shard with the tokens of that shard's pairs, under the number of the part's first text. From rows
    (doc_id, text, learn). With ``heavy`` and the ``model`` (weights, bias) the class part of tokens after heavy
    pairs is in a text's sum, and these tokens are not dealt."""
    sent = docs.sparkSession.sparkContext.broadcast((head, *((heavy, *model) if heavy is not None and len(heavy.pairs) else (None, None, None))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, hot, weights, bias = sent.value
        known, table = np.zeros(len(hot.pairs) if hot else 0, dtype=bool), np.zeros((len(hot.pairs) if hot else 0, CLASSES))
        number = TaskContext.get().partitionId() << 40
        for b in small_batches(batches, 2 << 20):
            t, n = tokens_of(b.column(1), h), b.num_rows
            target = _class_of(h, t.head)
            frequent = t.head >= 0
            base, model = np.zeros(len(target)), np.zeros(len(target))
            base[frequent] = np.log10((h.counts[t.head[frequent]] + 0.5) / h.base_total)
            model[frequent] = h.inside[t.head[frequent]]
            light = np.ones(len(target), dtype=bool)
            if hot:
                which, at = hot.place(t.pair)
                fresh, first = np.unique(at, return_index=True)
                first, fresh = first[~known[fresh]], fresh[~known[fresh]]
                for i in range(0, len(fresh), BATCH):  # a pair's features are those of any token after it
                    some = fresh[i:i + BATCH]
                    table[some] = heavy_scores(weights, bias, t.features[which[first[i:i + BATCH]]], hot.counts[some])
                known[fresh] = True
                model[which] += table[at, target[which]]
                light[which] = False
            rare = np.flatnonzero(~frequent)
            # an end token is rare only if there is no head at all: it is then the word ""
            key = t.doc[rare] * (len(t.words) + 1) + t.word[rare] + 1
            pair, times = np.unique(key, return_counts=True)
            owner, word = pair // (len(t.words) + 1), pair % (len(t.words) + 1) - 1
            names = pa.concat_arrays([t.words, pa.array([END], pa.string())]).take(pa.array(np.where(word < 0, len(t.words), word)))
            offsets = np.searchsorted(owner, np.arange(n + 1))
            cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([names, pa.array(times, pa.int64())], names=["token", "n"]))
            texts = [pa.array(np.arange(number, number + n), pa.int64()), pa.array(np.arange(number, number + n) % shards, pa.int32()), b.column(0),
                     pa.array(np.bincount(t.doc, minlength=n), pa.int64()), pa.array(np.bincount(t.doc, frequent, minlength=n).astype(np.int64)),
                     pa.array(np.bincount(t.doc, base, minlength=n)), pa.array(np.bincount(t.doc, model, minlength=n)), cells]
            yield pa.RecordBatch.from_arrays([*texts, *[pa.nulls(n, pa.binary())] * 3], schema=_DEALT_TYPE)
            dealt = _deal(t, target, np.asarray(b.column(2)), shards, light)
            k = len(dealt[0])
            yield pa.RecordBatch.from_arrays([pa.array([number] * k, pa.int64()), pa.array(dealt[0], pa.int32()), *[pa.nulls(k, x.type) for x in texts[2:]],
                                              *[pa.array(x, pa.binary()) for x in dealt[1:]]], schema=_DEALT_TYPE)
            number += n
    return docs.mapInArrow(run, f"row long, shard int, doc_id long, n_tokens long, known long, base double, model double, rare {RARE}, docs binary, low binary, high binary")


_TEXT = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", _RARE_TYPE)]
_DEALT_TYPE = pa.schema([("row", pa.int64()), ("shard", pa.int32()), *_TEXT, ("docs", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_SCORED_TYPE = pa.schema([("row", pa.int64()), *_TEXT, ("docs", pa.binary()), ("sums", pa.binary())])


def _deal(t: Tokens, target: np.ndarray, learn: np.ndarray, shards: int, light: np.ndarray) -> tuple[list, list, list, list]:
    """The ``light`` tokens by shard of their pair: shards; steps of text number; kinds 0 and 2 and class (32 bits); 15 bits of
    the pair, of which 13 are kind 1, and whether the token is learned from. With the shard this tells pairs apart."""
    light = np.flatnonzero(light)
    pair, doc, features = t.pair[light], t.doc[light], np.take(t.features, light, axis=0)
    shard = ((pair >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    low = (features[:, 0] << 19 | (features[:, 2] - 2 * BUCKETS) << 6 | target[light]).astype("<u4")[order]
    high = ((pair & np.uint64(0x7FFF)).astype(np.int64) << 1 | learn.astype(np.int64)[doc]).astype("<u2")[order]
    docs, ends = doc[order], np.searchsorted(shard[order], np.arange(shards + 1))
    some = [(k, i, j) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if i < j]
    return ([k for k, _, _ in some], [np.diff(docs[i:j], prepend=0).astype("<u4").tobytes() for _, i, j in some],
            [low[i:j].tobytes() for _, i, j in some], [high[i:j].tobytes() for _, i, j in some])


def class_scores(weights: np.ndarray, bias: np.ndarray, shard: np.ndarray, low: np.ndarray, high: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log10 P(class | history) of tokens; the learning ones among them are all that the shards have of their pairs."""
    key = (shard.astype(np.uint64) << np.uint64(47)) | (high.astype(np.uint64) >> np.uint64(1) << np.uint64(32)) | low.astype(np.uint64)
    order = np.argsort(key)
    key, learned = key[order], (high[order] & 1).astype(np.int64)
    if not len(key):
        return np.zeros(0)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n_class = np.add.reduceat(learned, starts)
    own = key[starts]
    pairs = np.flatnonzero(np.concatenate([[True], own[1:] >> np.uint64(6) != own[:-1] >> np.uint64(6)]))
    n_pair = np.add.reduceat(n_class, pairs)
    sizes = np.diff(np.append(pairs, len(own)))
    f = own[pairs]
    features = np.stack([f >> np.uint64(19) & np.uint64(BUCKETS - 1), (f >> np.uint64(32) & np.uint64(BUCKETS - 1)) + np.uint64(BUCKETS),
                         (f >> np.uint64(6) & np.uint64(BUCKETS - 1)) + np.uint64(2 * BUCKETS)], axis=1).astype(np.int64)
    target = (own & np.uint64(CLASSES - 1)).astype(np.int64)
    q = np.zeros(len(own))
    for i in range(0, len(pairs), BATCH):
        z = np.exp(_logits(weights, bias, features[i:i + BATCH]))
        a, b = pairs[i], pairs[i + BATCH] if i + BATCH < len(pairs) else len(own)
        at = np.repeat(np.arange(len(z)), sizes[i:i + BATCH])
        q[a:b] = z[at, target[a:b]] / z.sum(axis=1, dtype=np.float64)[at]
    q = np.maximum(q, 1e-30)
    of_key = np.log10(q + n_class / prior) - np.log10(1 + np.repeat(n_pair, sizes) / prior)
    out = np.empty(len(key))
    out[order] = np.repeat(of_key, np.diff(np.append(starts, len(key))))
    return out


def _score_pairs(dealt: DataFrame, weights: np.ndarray, bias: np.ndarray, tasks: int) -> DataFrame:
    """The rows of texts as they are, and for each part of a batch the class sums of its texts over a task's pairs."""
    sent = dealt.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        w, b0 = sent.value
        by_shard: dict[int, list[tuple]] = {}
        for b in batches:
            is_text = pc.is_null(b.column(8))
            texts, b = b.filter(is_text), b.filter(pc.invert(is_text))
            n = texts.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([texts.column(0), *texts.columns[2:8], pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_SCORED_TYPE)
            for row, shard, *cell in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), *b.columns[8:]))):
                by_shard.setdefault(shard, []).append((row, *cell))
        sums: dict[int, np.ndarray] = {}
        while by_shard:  # a shard at a time, for memory
            shard, cells = by_shard.popitem()
            low, high = (np.frombuffer(b"".join(c[k] for c in cells), kind) for k, kind in ((2, "<u4"), (3, "<u2")))
            got, start = class_scores(w, b0, np.full(len(low), shard, np.uint32), low, high), 0
            for row, docs, *_ in cells:
                at = np.cumsum(np.frombuffer(docs, "<u4")).astype(np.int64)
                add, start = np.bincount(at, got[start:start + len(at)]), start + len(at)
                old = sums.get(row, add[:0])
                if len(old) > len(add):
                    add, old = old, add
                add[:len(old)] += old
                sums[row] = add
        for row, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *[pa.nulls(1, x) for _, x in _TEXT], pa.array([np.diff(some, prepend=0).astype("<u4").tobytes()], pa.binary()),
                                              pa.array([total[some].astype("<f8").tobytes()], pa.binary())], schema=_SCORED_TYPE)
    return dealt.repartition(tasks, "shard").mapInArrow(
        run, f"row long, doc_id long, n_tokens long, known long, base double, model double, rare {RARE}, docs binary, sums binary")


def _class_sums(scored: DataFrame) -> DataFrame:
    """row, class_sum: the class part of every text's score."""
    def back(key: tuple, group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0)
        for part in group:
            for docs, sums in zip(part["docs"], part["sums"]):
                at = np.cumsum(np.frombuffer(docs, "<u4")).astype(np.int64)
                if len(at) and at[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(at[-1] + 1 - len(total))])
                total[at] += np.frombuffer(sums, "<f8")
        yield pd.DataFrame({"row": key[0] + np.arange(len(total)), "class_sum": total})
    return scored.where("docs is not null").select("row", "docs", "sums").groupBy("row").applyInPandas(back, "row long, class_sum double")


def scores(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD,
           rounds: int | None = None, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row per input
    row. base_score is log10 of an add-1/2 unigram model, score the log10
    probability by the maximum-entropy model; both learn from the rows where
    ``learn`` (a condition on doc_id) holds. ``heavy_share`` says which pairs are
    heavy; it is no part of the result."""
    rows = id_text(docs, id_col, text_col)
    learning = rows.where(learn) if learn is not None else rows
    every = store(count_all(learning, heavy_share), "maxent-counts")
    counts = only_tokens(every)
    head = make_head(counts, head_size)
    heavy = make_heavy(every, head.tokens, heavy_share)
    weights, bias = fit(learning, head, rounds or rounds_for(head.tokens), heavy=heavy)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), head.tokens // SHARD_TOKENS)
    marked = rows.withColumn("learn", F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True))
    found = store(_score_pairs(_score_head(marked, head, tasks * SHARES, heavy, (weights, bias)), weights, bias, tasks), "maxent-scored")
    scored, classes = found.where("docs is null").drop("docs", "sums"), _class_sums(found)
    floor = int(head.counts.min()) if len(head.counts) else 1 << 62
    rarer = counts.where(F.col("c") <= floor)  # words of the head never ask, so a few of them do no harm
    asked = scored.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = asked.join(rarer, "token", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum("n").alias("n_rare"),
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"))
    n_rare, logs = F.coalesce("n_rare", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").join(classes, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(head.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - n_rare * float(np.log10(head.base_total))).alias("base_score"),
        (F.col("model") + F.coalesce("class_sum", F.lit(0.0)) + logs - n_rare * float(np.log10(head.rare_total))).alias("score"))
