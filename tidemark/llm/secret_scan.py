"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate credentials; each candidate's value is hashed, and for
every hash the distinct repositories and owners that hold it are counted over
the whole corpus. A value held by many owners is a copied example; one held by
few that also looks random is live. Base kinds are always reported (with their
verdict); further kinds are reported only where the count and look say live.

Defined cases: a null text is empty and has no span; a null owner or repository
counts as one owner of its own name ''; repeated rows get a row each (and count
once as an owner); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, store

WIDELY = 4             # owners from which on a value is a copied example
WIDELY_COPIED = 64     # repositories from which on it is one whoever owns them
MIN_ENTROPY = 3.0      # bits a character of a live-looking value

#: Fixed patterns. Base kinds in their order, then the kinds that the ownership count decides on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs; shorter runs are dropped anyway
PROVIDER = re.compile(r"(?:ghp_|gho_|sk_live_|rk_live_|xox[abprs]-|AIza|glpat-)[A-Za-z0-9_-]{16,}")
URL = re.compile(r"[a-z][a-z0-9+.-]{1,12}://[^\s:/@]++:([^\s:/@]{6,}+)@")
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ["assign", "access", "hex", "provider", "url", "random"]
BASE = KINDS[:3]
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "your", "xxxx", "1234567", "abcdef")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def live_looking(value: str) -> bool:
    """Random enough, and not the usual placeholder wording."""
    low = value.lower()
    return entropy(value) >= MIN_ENTROPY and not any(p in low for p in PLACEHOLDERS)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind number, end, value start, value end): leftmost non-overlapping
    matches of each base kind, too short ones dropped; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def further_candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Candidates of the other kinds that overlap no base span nor each other."""
    starts, ends = [], []  # of the spans taken, merged where they overlap: both in order
    for s, e in sorted((s[0], s[2]) for s in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []

    def add(kind: int, m: re.Match, group: int = 0) -> None:
        a, b = m.span()
        k = bisect_right(ends, a)  # the first span that ends after the match begins
        if (k == len(starts) or b <= starts[k]) and live_looking(m.group(group)):
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((a, kind, b, *m.span(group)))
    for m in PROVIDER.finditer(text):
        add(3, m)
    if "://" in text:
        for m in URL.finditer(text):
            add(4, m, 1)
    for m in RANDOM.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v):
            add(5, m)
    return out


SPAN = "struct<start:long,kind:int,stop:long,value_start:long,value_stop:long,hash:long,looks:boolean>"
_SPAN_ARROW = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value_start", pa.int64()),
                         ("value_stop", pa.int64()), ("hash", pa.int64()), ("looks", pa.bool_())])


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """doc_id, text_hash, owner, repo, spans: a row per input row, all candidates in it."""
    from xxhash import xxh64_intdigest as xxh

    def signed(value: str) -> int:
        h = xxh(value.encode())
        return h - (1 << 64) if h >> 63 else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = []
            for text in b.column(4).to_pylist():
                base = base_spans(text) if text else []
                spans = base + (further_candidates(text, base) if text else [])
                found.append([dict(start=s, kind=k, stop=e, value_start=a, value_stop=z, hash=signed(text[a:z]),
                                   looks=live_looking(text[a:z])) for s, k, e, a, z in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(found, pa.list_(_SPAN_ARROW))],
                                             names=["doc_id", "text_hash", "owner", "repo", "spans"])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"),
                       F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, text_hash long, owner string, repo string, spans array<{SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: the distinct holders of each value, counted over the
    whole corpus (combined before each shuffle, so a value in a third of all rows
    is no large group)."""
    held = found.select("owner", "repo", F.explode("spans.hash").alias("hash"))
    owners = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = held.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "hash")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
         widely: int = WIDELY, widely_copied: int = WIDELY_COPIED) -> DataFrame:
    """doc_id, text_hash, spans: a row per input row; spans are those reported, in
    order of start and kind, each with kind, verdict ('live', 'example' or
    'unclear'), owners and repos. A value held by ``widely`` owners is a copied example,
    and so is one in ``widely_copied`` repositories, be they of one owner."""
    found = store(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    spans = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    verdict = (F.when((F.col("owners") >= widely) | (F.col("repos") >= widely_copied), F.lit("example")).when(F.col("looks"), F.lit("live")).otherwise(F.lit("unclear")))
    judged = (spans.join(ownership(found), "hash").withColumn("verdict", verdict)
              .where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                  "start", F.col("kind").alias("kind_no"), "stop", "value_start", "value_stop", F.element_at(kinds, F.col("kind") + 1).alias("kind"),
                  "verdict", "owners", "repos"))).alias("spans")))
    plain = found.select("row", "doc_id", "text_hash").join(judged, "row", "left")
    empty = F.expr("filter(array(named_struct('start', 0L, 'kind_no', 0, 'stop', 0L, 'value_start', 0L, 'value_stop', 0L, 'kind', '', "
                   "'verdict', '', 'owners', 0L, 'repos', 0L)), x -> false)")
    return plain.select("doc_id", "text_hash", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           length_col: str | None = None) -> DataFrame:
    """``docs`` with the value of every reported span replaced by ``mark`` and,
    in those rows, ``length_col`` (if given) set to the new text's code points;
    all other rows and columns as they are."""
    hits = (found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
                                                  F.transform("spans", lambda s: F.struct(s["value_start"].alias("a"), s["value_stop"].alias("z"))).alias("hit_values"))
            .dropDuplicates(["hit_id", "hit_hash"]))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(at).to_pylist()
            lengths = b.column(names.index(length_col)).to_pylist() if length_col else []
            for i, values in enumerate(b.column(len(names)).to_pylist()):
                if values:
                    text, out, upto = texts[i], [], 0
                    for v in sorted(values, key=lambda v: (v["a"], v["z"])):
                        if v["z"] > upto:
                            if v["a"] >= upto:
                                out += [text[upto:v["a"]], mark]
                            upto = v["z"]
                    texts[i] = "".join(out) + text[upto:]
                    if length_col:
                        lengths[i] = len(texts[i])
            columns = [b.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if length_col:
                columns[names.index(length_col)] = pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)
    text_hash = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    joined = docs.join(hits, F.col(f"`{id_col}`").eqNullSafe(F.col("hit_id")) & (text_hash == F.col("hit_hash")), "left")
    return joined.select(*[docs[f"`{c}`"] for c in names], "hit_values").mapInArrow(run, docs.schema)
