"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are folded first: case, look-alike letters of other scripts, and digits or
signs that stand for letters. The lexicon holds folded words and word beginnings
with log-odds weights learned from labelled texts; exception phrases cancel the
matches inside them. The sum of weights, alone and over the text's length, goes
through a logistic fitted on labelled texts that the lexicon was not drawn from.

The labelled sample is bounded (``SAMPLE``), so what is broadcast and collected
does not grow; whole texts are read, in the sample and in scoring.

Defined cases: null and empty texts have no match and get the score of a text
without matches; rows without a label, or labelled null, teach nothing; a
document labelled twice counts as toxic if either label is; of several texts of
one id the one with the smallest hash teaches; entries of equal evidence rank by
their text; repeated rows get a row each; without labels of both kinds every score is 0; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, small_batches, store

SAMPLE = 16_000          # labelled texts read in training, about
MAX_LEXICON = 2_000      # entries of the model
PREFIXES = (3, 4, 5, 6, 7, 8)
MIN_EVIDENCE = 20.0      # log-likelihood ratio an entry needs

MIN_RATIO = 16.0         # how much more often in toxic than in clean texts
COPIES = 4               # hashes by which a copy in the sample is known; two equal ones tell it

#: Fixed look-alikes: character -> Latin letters it is read as, in order.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ǀ": "l",
}
#: Fixed substitutions inside a word; i, l, 1, ! and | are read as one letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
#: Signs that also end sentences; they stand for i only between letters.
INNER = ("!", "|")


def _folding() -> dict[int, str]:
    out: dict[int, str] = {}
    for code in [*range(128), *range(0x80, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), *range(0x3000, 0x3004)]:
        if not chr(code).isalpha():
            out[code] = " "
    for code in range(0x200B, 0x2010):
        out[code] = ""  # zero-width characters
    out[0xAD] = ""
    out |= {0xFF21 + k: chr(97 + k) for k in range(26)} | {0xFF41 + k: chr(97 + k) for k in range(26)}
    out |= {ord(c): to for c, to in LOOKALIKES.items()} | {ord(c): to for c, to in SUBSTITUTES.items()}
    for code, to in list(out.items()):
        out[code] = out.get(ord(to), to) if len(to) == 1 and to != " " else to
    return out


FOLD = _folding()


def fold_text(text: str | None) -> str:
    """Folded words, each between blanks."""
    if not text:
        return " "
    low = text.lower()
    for sign in INNER:
        if sign in low:
            parts = low.split(sign)
            low = parts[0]
            for p in parts[1:]:
                low += ("i" if low[-1:].isalpha() and p[:1].isalpha() else " ") + p
    return " " + low.translate(FOLD) + " "


def entries_of(folded: str) -> set[str]:
    """What a text offers the lexicon: ' word ' for its words, ' begin' for word beginnings."""
    words = {w for w in folded.split() if len(w) > 2}
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    logistic: tuple[float, float, float] | None = None

    def matcher(self):
        """A function: folded text -> weights of its matches outside exception phrases."""
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in self.weights.items():
            automaton.add_word(entry, (len(entry), weight))
        if not len(automaton):
            return lambda folded: []
        automaton.make_automaton()

        def match(folded: str) -> list[float]:
            found, excused = [], []
            for end, (size, weight) in automaton.iter(folded):
                if weight:
                    found.append((end - size + 1, end, weight))
                else:
                    excused.append((end - size + 1, end))
            if excused:
                found = [m for m in found if not any(a <= m[0] and m[1] <= z for a, z in excused)]
            return [m[2] for m in found]
        return match

    def features(self, match, folded: str) -> tuple[float, float]:
        total = sum(match(folded))
        return math.log1p(total), math.log1p(100.0 * total / (1 + folded.count(" ")))

    def score(self, match, folded: str) -> float:
        if self.logistic is None:
            return 0.0
        a, b, c = self.logistic
        x, y = self.features(match, folded)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c))))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton steps with a ridge; the classes weigh the same."""
    design = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (share * (p - y)) + ridge * w * [1, 1, 0]
        bend = (design * (share * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + np.diag([ridge, ridge, 1e-9])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries by evidence; one inside another chosen one says nothing new."""
    scored = []
    for entry, t, c in counts:
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        # about equal evidence: rather a whole word, then a long beginning
        scored.append((-round(20 * math.log(t * weight)), not entry.endswith(" "), -len(entry), entry, weight))
    chosen: dict[str, float] = {}
    for _, _, _, entry, weight in sorted(scored):
        stem = entry.rstrip(" ")
        if any(stem[:k] in chosen for k in range(PREFIXES[0] + 1, len(stem) + 1)):
            continue
        if any(e.startswith(stem) for e in chosen):
            continue
        chosen[entry] = weight
        if len(chosen) == MAX_LEXICON:
            break
    return chosen


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn from about ``sample`` labelled rows where ``learn`` (a condition on
    ``id_col``) holds, drawn by a hash of the id: two thirds give the lexicon and
    exceptions, the rest the logistic."""
    spark = docs.sparkSession
    known = (labels.select(F.col(f"`{label_id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null")
             .where(F.lit(True) if learn is None else learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30))))
    n = known.count()
    drawn = known.where(F.col("h") < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))).select("doc_id", "toxic", F.pmod("h", F.lit(3)).alias("part"))
    # about ``sample`` ids and labels are broadcast; their texts are read from a small table from here on
    found = id_text(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))  # of several texts of an id always the same one
    texts = store(found.groupBy("doc_id", "toxic", "part").agg(first.alias("first")).select("doc_id", "first.text", "toxic", "part"), "toxicity-sample")
    ids = {d: (int(toxic == 1), part) for d, toxic, part in _one_of_each(texts)}
    sent = spark.sparkContext.broadcast(ids)
    texts = texts.select("doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in small_batches(batches):
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d in sent.value and sent.value[d][1] != 2:
                    tables[sent.value[d][0]].update(entries_of(fold_text(text)))
        for label, found in tables.items():
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([label] * len(found), pa.int32()),
                                                  pa.array(list(found.values()), pa.int64())], names=["entry", "label", "n"])
    toxic = sum(t for t, p in ids.values() if p != 2)
    clean = sum(1 - t for t, p in ids.values() if p != 2)
    if not toxic or not clean:
        return Lexicon({})
    tallied = (texts.mapInArrow(count, "entry string, label int, n long").groupBy("entry")
               .agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("t"), F.sum(F.expr("if(label = 0, n, 0)")).alias("c")))
    share_t, share_c = toxic / (toxic + clean), clean / (toxic + clean)
    both = F.col("t") + F.col("c")

    def term(n_seen: Column, expected: Column) -> Column:
        return F.when(n_seen > 0, n_seen * F.log(n_seen / expected)).otherwise(0.0)
    evidence = 2 * (term(F.col("t"), both * share_t) + term(F.col("c"), both * share_c))
    counts = [tuple(r) for r in tallied.where((F.col("t") >= 3) & (F.col("t") / toxic > MIN_RATIO * F.col("c") / clean) & (evidence >= MIN_EVIDENCE))
              .orderBy(F.desc(evidence), "entry").limit(10 * MAX_LEXICON).collect()]
    lexicon = Lexicon(_choose(counts, toxic, clean))
    lexicon.exceptions = _exceptions(texts, sent, lexicon)
    rows = _features(texts, sent, lexicon)
    if len({y for _, _, y in rows}) == 2:
        grid = np.array(rows, dtype=np.float64)
        lexicon.logistic = _fit_logistic(grid[:, :2], grid[:, 2])
    return lexicon


def _one_of_each(texts: DataFrame) -> list[tuple[int, int, int]]:
    """(doc_id, toxic, part) of the sample, one of each group of near copies: else
    the words of a much copied text would pass for evidence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh
        turns = np.array([xxh(b"turn", k) | 1 for k in range(COPIES)], dtype=np.uint64)
        for b in small_batches(batches):
            marks = []
            for text in b.column(1).to_pylist():
                words = fold_text(text).encode().split() or [b""]
                hashes = np.array([xxh(b" ".join(w)) for w in zip(words, words[1:], words[2:])] or [xxh(b" ".join(words))], dtype=np.uint64)
                marks.append([int(v) for v in ((hashes[:, None] * turns) >> np.uint64(1)).min(axis=0)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(marks, pa.list_(pa.int64()))],
                                             names=["doc_id", "toxic", "part", "marks"])
    rows = texts.mapInArrow(run, "doc_id long, toxic int, part long, marks array<long>").collect()
    first: dict[tuple[int, int], int] = {}
    kept = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        before = Counter(first.setdefault((k, v), r["doc_id"]) for k, v in enumerate(r["marks"]))
        before.pop(r["doc_id"], None)
        if max(before.values(), default=0) < 2 and (not kept or kept[-1][0] != r["doc_id"]):
            kept.append((r["doc_id"], r["toxic"], r["part"]))
    return kept


def _exceptions(texts: DataFrame, sent, lexicon: Lexicon) -> list[str]:
    """Word pairs around a match that occur in clean texts of the sample at least
    three times and in no toxic one: phrases in which the word is harmless."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        stems = tuple(e.strip() for e in lexicon.weights)
        for b in small_batches(batches):
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if stems and d in sent.value and sent.value[d][1] != 2:
                    words = fold_text(text).split()
                    near = {(" ".join(words[max(0, j):j + 2])) for k, w in enumerate(words) if w.startswith(stems) for j in (k - 1, k)}
                    pairs.update((p, sent.value[d][0]) for p in near if " " in p)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([f" {p} " for p, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32()),
                                              pa.array(list(pairs.values()), pa.int64())], names=["pair", "label", "n"])
    tallied = texts.mapInArrow(run, "pair string, label int, n long").groupBy("pair").agg(
        F.sum(F.expr("if(label = 1, n, 0)")).alias("t"), F.sum(F.expr("if(label = 0, n, 0)")).alias("c"))
    return [r["pair"] for r in tallied.where("t = 0 and c >= 3").orderBy(F.desc("c"), "pair").limit(MAX_LEXICON).collect()]


def _features(texts: DataFrame, sent, lexicon: Lexicon) -> list[tuple[float, float, int]]:
    """Features and label of the sample's last third."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for b in small_batches(batches):
            rows = [(*lexicon.features(match, fold_text(t)), sent.value[d][0]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    if d in sent.value and sent.value[d][1] == 2]
            if rows:
                x, y, label = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(label, pa.int32())], names=["x", "y", "label"])
    return [tuple(r) for r in texts.mapInArrow(run, "x double, y double, label int").collect()]


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_matches: a row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = sent.value.matcher()
        for b in small_batches(batches):
            folded = [fold_text(t) for t in b.column(1).to_pylist()]
            scores = [sent.value.score(match, f) for f in folded]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                                              pa.array([len(match(f)) for f in folded], pa.int64())],
                                             names=["doc_id", "score", "predicted", "n_matches"])
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
