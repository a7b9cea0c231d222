"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import store


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the smallest node in u's neighbourhood."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (near.where("v > u").join(low, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                  F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["x"], r["s"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, root): root is the smallest node reachable.

    Each round aggregates a minimum per node (combined before the shuffle) and
    joins it back, so a hub with very many neighbours is never gathered in one
    group; AQE splits the join on a hub. Rounds grow with the logarithm of the
    longest chain. Each round is written to the shared folder. Null ends and
    loops are ignored; an empty table gives an empty table. Raises if it has not
    settled after ``max_rounds``.
    """
    edges = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = store(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
