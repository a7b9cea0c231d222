"""Prefix trie of conversations, as z-fast tries over batches merged by key.

A conversation is a sequence of turns (role, text). The key of a prefix is the
exclusive or, in two 64-bit lanes, of its turns' digests mixed with their
positions, so a path is two arrays of running keys and equal keys mean equal
prefixes (128 bits). Very long conversations are cut into stretches of ``STRETCH``
turns, which start from the key before them.

1. ``rebuilt``: turns numbered in sorted ranges (a conversation may span many),
   texts reduced to digests and word counts where they are read.
2. Tasks insert paths, in batches of bounded size, into a z-fast trie: a hash
   table holds each compacted node under the key of its handle, the prefix whose
   length is the two-fattest number on the node's edge. A fat binary search finds
   the deepest node on the path in log(length) look-ups, the exit node follows,
   its edge is split and a leaf added. Members are counted where they end and
   summed upwards once a batch is full; then edges are expanded into nodes.
3. Batches meet by key: a node arrives once from each batch, however many
   conversations pass it.
4. Sums over subtrees need no rounds: a node belongs to its smallest member m,
   and m's nodes are the tail of m's path. Every node on m's path receives the
   sum of m's nodes below it; sums of all members give the subtree's.

Defined cases: rows without conv_id take no part; null role or text is empty; a
null turn comes first; rows of equal turn are ordered by the digest of role and
text (its first 128 bits as two signed numbers); a repeated row is a turn of its own; a conversation whose turns are all
replaced by nothing is a member of the root alone; very long texts are read
whole; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import store

#: Turns of a conversation that one row holds.
STRETCH = 4096
#: Turns in a task's trie before it is expanded.
BATCH_TURNS = 500_000
KEY = ["depth", "k1", "k2"]


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: the edge (start, end] of the path ``keys``."""
    __slots__ = ("start", "end", "path", "parent", "n", "least")

    def __init__(self, start: int, end: int, path: "Path", parent: "Node | None"):
        self.start, self.end, self.path, self.parent, self.n, self.least = start, end, path, parent, 0, None


class Path:
    """One stretch: conversation, first depth, and arrays of keys and words by depth."""
    __slots__ = ("conv_id", "base", "k1", "k2", "o1", "o2", "words", "keys")

    def __init__(self, conv_id: int, base: int, k1: np.ndarray, k2: np.ndarray, o1: int, o2: int, words: np.ndarray):
        self.conv_id, self.base, self.k1, self.k2, self.o1, self.o2, self.words = conv_id, base, k1, k2, o1, o2, words
        self.keys = list(zip(k1.tolist(), k2.tolist()))


class ZFastTrie:
    """Keys name a prefix with its depth (positions are mixed in), so one table serves all stretches."""

    def __init__(self):
        self.roots: dict[tuple, Node] = {}
        self.handles: dict[tuple, Node] = {}  # key of the handle -> node
        self.first: dict[tuple, Node] = {}  # key of the first prefix on the edge -> node
        self.nodes: list[Node] = []
        self.turns = 0

    def _place(self, node: Node) -> Node:
        keys = node.path.keys
        self.handles[keys[fattest(node.start, node.end) - 1]] = node
        self.first[keys[node.start]] = node
        return node

    def _add(self, start: int, end: int, path: Path, parent: Node) -> Node:
        node = Node(start, end, path, parent)
        self.nodes.append(node)
        return self._place(node)

    def exit(self, root: Node, keys: list) -> tuple[Node, Node | None]:
        """The deepest node whose extent is a prefix of the path, and the node
        on whose edge the path leaves the trie (None: it ends at or branches from that node)."""
        node, low, high = root, 0, len(keys)
        while low < high:
            f = fattest(low, high)
            found = self.handles.get(keys[f - 1])
            if found is None:
                high = f - 1
            elif found.end <= len(keys) and found.path.keys[found.end - 1] == keys[found.end - 1]:
                node, low = found, found.end
            else:
                return node, found
        return node, self.first.get(keys[node.end]) if node.end < len(keys) else None

    def insert(self, path: Path) -> None:
        keys = path.keys
        root = self.roots.get((path.base, path.o1, path.o2))
        if root is None:
            root = self.roots[path.base, path.o1, path.o2] = Node(0, 0, path, None)
        node, out = self.exit(root, keys)
        if out is not None:
            low, high, theirs = out.start + 1, min(out.end, len(keys)), out.path.keys
            while low < high:  # the last depth at which both paths agree
                mid = (low + high + 1) // 2
                if theirs[mid - 1] == keys[mid - 1]:
                    low = mid
                else:
                    high = mid - 1
            del self.handles[theirs[fattest(out.start, out.end) - 1]]
            node = self._add(out.start, low, out.path, out.parent)
            out.start, out.parent = low, node
            self._place(out)
        if node.end < len(keys):
            node = self._add(node.end, len(keys), path, node)
            self.turns += len(keys)
        node.n += 1
        node.least = path.conv_id if node.least is None else min(node.least, path.conv_id)

    def expand(self) -> Iterator[pa.RecordBatch]:
        """The nodes of all depths with their members' number and smallest id; empties the trie."""
        ordered = sorted(self.nodes, key=lambda v: -v.end)
        for v in ordered:
            if v.parent is not None:
                v.parent.n += v.n
                v.parent.least = v.least if v.parent.least is None else min(v.parent.least, v.least)
        for i in range(0, len(ordered), 5_000):
            part = ordered[i:i + 5_000]
            lengths = [v.end - v.start for v in part]

            def joined(cut) -> np.ndarray:
                return np.concatenate([cut(v) for v in part])
            depth = joined(lambda v: np.arange(v.path.base + v.start + 1, v.path.base + v.end + 1))
            k1, k2 = (joined(lambda v: getattr(v.path, c)[v.start:v.end]) for c in ("k1", "k2"))
            before = [(v.path.keys[v.start - 1] if v.start else (v.path.o1, v.path.o2)) for v in part]
            starts = np.cumsum([0] + lengths[:-1])
            p1, p2 = np.roll(k1, 1), np.roll(k2, 1)
            p1[starts], p2[starts] = [b[0] for b in before], [b[1] for b in before]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (depth, k1, k2, p1, p2, joined(lambda v: v.path.words[v.start:v.end]),
                                                   np.repeat([v.n for v in part], lengths), np.repeat([v.least for v in part], lengths))],
                names=["depth", "k1", "k2", "p1", "p2", "words", "n", "conv_id"])
        self.__init__()


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos and the other columns: a turn's place in its conversation.
    Ranges of the sorted table are numbered alone; what a range's first
    conversation has in ranges before comes from a row per range."""
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            new = np.flatnonzero(np.concatenate([[conv[0] != now], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv)) + seen
            if len(new):
                place[new[0]:] -= np.repeat(place[new], np.diff(np.append(new, len(conv))))
            now, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(conv), part), pa.int64()), pa.array(place, pa.int64()), *b.columns[1:]],
                                             names=["conv_id", "part", "pos", "t1", "t2", "words"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "words")
    numbered = store(ranged.mapInArrow(run, "conv_id long, part long, pos long, t1 long, t2 long, words long"), "trie-turns")
    # One row per range: its first and last conversation, and the rows of the last one.
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("low"), F.max(F.struct("conv_id", "pos")).alias("high")).collect()
    carried, open_id, rows = [], None, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        before = rows if r["low"] == open_id else 0
        carried.append((r["part"], r["low"], before))
        rows = r["high"]["pos"] + 1 + (before if r["high"]["conv_id"] == r["low"] else 0)
        open_id = r["high"]["conv_id"]
    if not any(b for _, _, b in carried):
        return numbered.drop("part")
    more = F.broadcast(spark.createDataFrame([c for c in carried if c[2]], "part long, conv_id long, before long"))  # at most a row per range
    return numbered.join(more, ["part", "conv_id"], "left").withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0))).drop("part", "before")


def rebuilt(conversations: DataFrame, template: Column, taken: Column, most_taken: int, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos, t1, t2, words: a row per turn of every rebuilt conversation
    (the first ``taken`` turns of the conversation ``template``, then its own after as
    many), and a row with pos null for one without turns. ``template`` and ``taken``
    are expressions of conv_id; taken is at most ``most_taken``."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), digest.alias("d"),
                                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).where("conv_id is not null")
    lanes = [F.conv(F.substring("d", i, 16), 16, -10).cast("long").alias(t) for i, t in ((1, "t1"), (17, "t2"))]
    numbered = _numbered(store(turns.select("conv_id", "turn", *lanes, "words"), "trie-digests"))
    convs = numbered.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    convs = convs.select("conv_id", "own", template.alias("base"), taken.alias("h"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = store(convs.join(lengths, "base", "left").select("conv_id", "base", "own", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k")), "trie-convs")
    heads = numbered.where(F.col("pos") < most_taken).withColumnRenamed("conv_id", "base")
    from_template = convs.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "t1", "t2", "words")
    short = convs.where("k < h").select("conv_id", "k")
    own = numbered.where(F.col("pos") >= taken).join(short, "conv_id", "left").select(
        "conv_id", (F.col("pos") - taken + F.coalesce("k", taken)).alias("pos"), "t1", "t2", "words")
    none = convs.where("k = 0 and own <= h").selectExpr("conv_id", "cast(null as long) pos", "0L t1", "0L t2", "0L words")
    return from_template.unionByName(own).unionByName(none)


def _mixed(lane: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A lane with its position mixed in (a 64-bit finaliser)."""
    x = lane.astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _paths(turns: DataFrame, stretch: int) -> DataFrame:
    """conv_id, base, o1, o2, k1, k2, words: a row per stretch, with the running
    keys of its prefixes as bytes and the key before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            pos, t1, t2, words = (np.asarray(c) for c in flat.flatten())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((pos, owner))
            cut = np.cumsum(sizes)
            parts: list[list] = [[], [], []]
            ends = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
            for lane, t in enumerate((t1, t2)):
                run_key = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(_mixed(t[order], pos[order]))]).astype(np.uint64)
                before = run_key[cut - sizes]
                keys = (run_key[1:] ^ np.repeat(before, sizes)).view(np.int64)
                parts[lane] = [keys[e - s:e].tobytes() for s, e in zip(sizes, cut)]
                ends[lane] = (run_key[cut] ^ before).view(np.int64)
            parts[2] = [words[order][e - s:e].astype("<i4").tobytes() for s, e in zip(sizes, cut)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.asarray(b.column(1)) * stretch, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64()), *[pa.array(p, pa.binary()) for p in parts]],
                names=["conv_id", "base", "n", "e1", "e2", "k1", "k2", "words"])
    at = F.floor(F.coalesce("pos", F.lit(0)) / stretch).cast("long")
    grouped = turns.groupBy("conv_id", at.alias("part")).agg(
        F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "t1", "t2", "words"))).alias("turns"))
    paths = store(grouped.mapInArrow(run, "conv_id long, base long, n long, e1 long, e2 long, k1 binary, k2 binary, words binary"), "trie-paths")
    before = Window.partitionBy("conv_id").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    if not paths.where("base > 0").limit(1).count():
        return paths.selectExpr("*", "0L o1", "0L o2")
    # Stretches are one row for 4,096 turns: their keys are chained in a window of small rows.
    many = paths.where("base > 0").select("conv_id").distinct()
    chained = paths.select("conv_id", "base", "e1", "e2").join(many, "conv_id", "left_semi").select(
        "conv_id", "base", *[F.coalesce(F.bit_xor(e).over(before), F.lit(0)).alias(o) for e, o in (("e1", "o1"), ("e2", "o2"))])
    return store(paths.join(chained.where("base > 0"), ["conv_id", "base"], "left").na.fill(0, ["o1", "o2"]), "trie-chained")


_PATH = ["conv_id", "base", "o1", "o2", "k1", "k2", "words"]


def _path(conv_id: int, base: int, o1: int, o2: int, k1: bytes, k2: bytes, words: bytes) -> Path:
    return Path(conv_id, base, np.frombuffer(k1, "<i8") ^ o1, np.frombuffer(k2, "<i8") ^ o2, o1, o2, np.frombuffer(words, "<i4").astype(np.int64))


def _nodes(paths: DataFrame, batch_turns: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                trie.insert(_path(*row))
                if trie.turns > batch_turns:
                    yield from trie.expand()
        yield from trie.expand()
    local = paths.where("n > 0").select(_PATH).mapInArrow(run, "depth long, k1 long, k2 long, p1 long, p2 long, words long, n long, conv_id long")
    return local.groupBy(KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"), F.sum("n").alias("n_convs"),
                                  F.min("conv_id").alias("conv_id"))


def _lifted(paths: DataFrame, owned: DataFrame, stretch: int) -> DataFrame:
    """For every prefix of a path whose conversation owns nodes, the sums of those
    at or below it: depth, k1, k2, saved, leaves."""
    at = (F.floor((F.col("depth") - 1) / stretch) * stretch).cast("long")
    own = owned.groupBy("conv_id", at.alias("base")).agg(F.collect_list(F.struct("depth", "saved", "leaf")).alias("own"),
                                                         F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    here = paths.where("n > 0").select(_PATH)
    if paths.where("base > 0").limit(1).count():  # sums of later stretches; rows are stretches
        own = store(own, "trie-own")
        many = paths.where("base > 0").select("conv_id").distinct()
        later = Window.partitionBy("conv_id").orderBy(F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
        sums = paths.select("conv_id", "base").join(many, "conv_id", "left_semi").join(own.select("conv_id", "base", "saved", "leaves"), ["conv_id", "base"], "left")
        sums = sums.select("conv_id", "base", *[F.sum(F.coalesce(c, F.lit(0))).over(later).alias(f"later_{c}") for c in ("saved", "leaves")])
        here = here.join(own.select("conv_id", "base", "own"), ["conv_id", "base"], "left").join(sums, ["conv_id", "base"], "left").where("own is not null or later_leaves > 0")
    else:
        here = here.join(own.select("conv_id", "base", "own"), ["conv_id", "base"]).selectExpr("*", "0L later_saved", "0L later_leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], [], []]
            for *row, own, saved, leaves in zip(*(c.to_pylist() for c in b.columns)):
                p = _path(*row)
                add = np.zeros((2, len(p.k1)), np.int64)
                for x in own or ():
                    add[:, x["depth"] - p.base - 1] = x["saved"], x["leaf"]
                sums = np.cumsum(add[:, ::-1], axis=1)[:, ::-1] + np.array([[saved or 0], [leaves or 0]])
                for c, v in zip(columns, (np.arange(p.base + 1, p.base + 1 + len(p.k1)), p.k1, p.k2, sums[0], sums[1])):
                    c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=[*KEY, "saved", "leaves"])
    return here.select(*_PATH, "own", "later_saved", "later_leaves").mapInArrow(run, "depth long, k1 long, k2 long, saved long, leaves long")


def _ends(paths: DataFrame) -> DataFrame:
    """depth, k1, k2, sha: digest of the members that end at a node. The digest of
    one node is sequential by its definition; its ids stream through a sorted range, none is held."""
    last = paths.groupBy("conv_id").agg(F.max(F.struct("base", "n", (F.col("e1").bitwiseXOR(F.col("o1"))).alias("k1"), (F.col("e2").bitwiseXOR(F.col("o2"))).alias("k2"))).alias("x"))
    ends = last.select((F.col("x.base") + F.col("x.n")).alias("depth"), "x.k1", "x.k2", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            out: list[tuple] = []
            for *key, conv_id in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if digest is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(b"%d" % conv_id)
                else:
                    digest.update(b",%d" % conv_id)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "sha"], o)) for o in out])
        if digest is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "sha"], (*now, digest.hexdigest())))])
    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(run, "depth long, k1 long, k2 long, sha string")


def prefix_trie(turns: DataFrame, stretch: int = STRETCH, batch_turns: int = BATCH_TURNS) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, words (of the last turn): a row per node,
    from ``rebuilt`` turns or any of conv_id, pos (from 0, gapless; null: no turns), t1, t2 (digest), words."""
    paths = _paths(turns, stretch)
    nodes = store(_nodes(paths, batch_turns), "trie-nodes")
    ends = store(_ends(paths), "trie-ends")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children.where("depth > 0"), KEY, "left").na.fill(0, ["n_children"])
    known = store(known.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-known")
    sums = _lifted(paths, known.select("conv_id", "depth", "saved", "leaf"), stretch).groupBy(KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    # Nodes of depth 1 have the root for a parent; an own key for each keeps them off one task.
    first = F.col("depth") == 1
    asked = known.drop("saved", "leaf").withColumn("up", F.when(first, F.lit(-1)).otherwise(F.col("depth") - 1)).withColumn(
        "p1", F.when(first, F.col("k1")).otherwise(F.col("p1"))).withColumn("p2", F.when(first, F.col("k2")).otherwise(F.col("p2")))
    above = known.select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # The root: one row of totals.
    members = paths.where("base = 0").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    total = known.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.sum(first.cast("long")).alias("children")).first()
    at_root = ends.where("depth = 0").select("sha").first()
    empty = hashlib.sha256().hexdigest()
    out = asked.join(above, ["up", "p1", "p2"], "left").join(sums, KEY).join(ends, KEY, "left").select(
        "conv_id", "depth", F.when(first, F.lit(members["conv_id"])).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("sha", F.lit(empty)).alias("ends_sha256"), "words")
    root = [(members["conv_id"], 0, None, members["n_convs"], total["children"] or 0, total["leaves"] or 1, total["saved"] or 0, at_root["sha"] if at_root else empty, 0)]
    return out.unionByName(turns.sparkSession.createDataFrame(root if members["n_convs"] else [], out.schema))
