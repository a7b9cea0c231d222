"""Exact per-row feature attribution for the boosted trees (path-dependent
Shapley values on the margin).

For a tree, the path-dependent expectation given a feature subset S is
    E[f | x_S] = sum_leaves v_l * prod_{j on path(l)} (a_lj if j in S else b_lj)
where a_lj is 1 when the row follows every split on feature j along the path
and b_lj is the product of the cover ratios of those splits. Each leaf is a
product game over its <= depth distinct path features, so its Shapley values
depend only on the row's 0/1 pattern (a_lj)_j: at most 2^depth patterns.
Those per-leaf tables are computed once on the driver from the model (bounded
by the model size, not the data), broadcast, and applied to Arrow batches in
``mapInPandas`` as vectorised gathers. Contributions plus the base value add
up to the margin (tested).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CACHE: dict[tuple[str, str], list] = {}


def _flatten_tree(root) -> list[dict]:
    """Nodes of one JVM tree as dicts (feature, threshold, left, right, value, cover)."""
    nodes: list[dict] = []

    def walk(node) -> int:
        idx = len(nodes)
        rec = {"value": float(node.prediction()), "cover": float(node.impurityStats().count())}
        nodes.append(rec)
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rec["feature"] = int(split.featureIndex())
            rec["threshold"] = float(split.threshold())
            rec["left"] = walk(node.leftChild())
            rec["right"] = walk(node.rightChild())
        else:
            rec["feature"] = -1
        return idx

    walk(root)
    return nodes


def _shapley_table(m: int, b: np.ndarray, v: float) -> np.ndarray:
    """Shapley values of the product game prod_j (a_j if j in S else b_j) for every
    0/1 pattern a (rows) and player (columns), times the leaf value v.
    phi_i(a) = v (a_i - b_i) sum_k k!(m-k-1)!/m! e_k, where e_k is the coefficient
    of t^k in prod_{j != i} (b_j + a_j t); vectorised over the 2^m patterns."""
    pats = np.arange(2 ** m)
    A = ((pats[:, None] >> np.arange(m)[None, :]) & 1).astype(float)
    w = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    table = np.zeros((2 ** m, m))
    for i in range(m):
        coeffs = np.ones((2 ** m, 1))
        for j in range(m):
            if j == i:
                continue
            nxt = np.zeros((2 ** m, coeffs.shape[1] + 1))
            nxt[:, :-1] += coeffs * b[j]
            nxt[:, 1:] += coeffs * A[:, j:j + 1]
            coeffs = nxt
        table[:, i] = v * (A[:, i] - b[i]) * (coeffs @ w[:coeffs.shape[1]])
    return table


def _leaf_tables(nodes: list[dict], weight: float) -> list[dict]:
    """Per leaf: path conditions and the Shapley lookup table over path patterns."""
    out = []

    def walk(i: int, path: list[tuple[int, float, bool, float]]):
        n = nodes[i]
        if n["feature"] < 0:
            feats = sorted({f for f, _, _, _ in path})
            m = len(feats)
            b = np.ones(m)
            for f, _thr, _left, ratio in path:
                b[feats.index(f)] *= ratio
            v = n["value"] * weight
            table = _shapley_table(m, b, v) if m else np.zeros((1, 1))
            base = v * float(np.prod(b)) if m else v
            out.append({"path": path, "feats": feats, "table": table, "base": base})
            return
        c = n["cover"] or 1.0
        lc, rc = nodes[n["left"]]["cover"], nodes[n["right"]]["cover"]
        walk(n["left"], path + [(n["feature"], n["threshold"], True, lc / c)])
        walk(n["right"], path + [(n["feature"], n["threshold"], False, rc / c)])

    walk(0, [])
    return out


def _nodes_from_saved(spark, model_dir: str) -> dict[int, list[dict]]:
    """Read the node table a saved tree-ensemble model writes (one row per node;
    bounded by the model size) and rebuild each tree's node list."""
    rows = spark.read.parquet(f"{model_dir}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = {}
    for tid, byid in trees.items():
        nodes: list[dict] = []

        def walk(nid: int) -> int:
            r = byid[nid]
            idx = len(nodes)
            rec = {"value": float(r["prediction"]), "cover": float(r["impurityStats"][0])}
            nodes.append(rec)
            if r["leftChild"] >= 0:
                rec["feature"] = int(r["featureIndex"])
                rec["threshold"] = float(r["leftCategoriesOrThreshold"][0])
                rec["left"] = walk(r["leftChild"])
                rec["right"] = walk(r["rightChild"])
            else:
                rec["feature"] = -1
            return idx

        root = min(byid)  # node ids are assigned in pre-order; the root has the smallest id
        walk(root)
        out[tid] = nodes
    return out


def explain_tables(gbt_model, saved_dir: str | None = None) -> list:
    """Leaf tables of every tree of a Spark GBT model (cached for a saved model,
    by its path and uid; a model object's address may be reused by another).
    With ``saved_dir`` the nodes come from the saved model's parquet node table;
    otherwise they are walked through the JVM objects."""
    key = (saved_dir, gbt_model.uid)
    if saved_dir is None or key not in _CACHE:
        weights = list(gbt_model.treeWeights)
        leaves = []
        if saved_dir:
            from pyspark.sql import SparkSession
            trees = _nodes_from_saved(SparkSession.getActiveSession(), saved_dir)
            for t in range(len(weights)):
                leaves.extend(_leaf_tables(trees[t], float(weights[t])))
        else:
            jtrees = gbt_model._java_obj.trees()
            for t in range(len(weights)):
                leaves.extend(_leaf_tables(_flatten_tree(jtrees[t].rootNode()), float(weights[t])))
        if saved_dir is None:
            return leaves
        _CACHE[key] = leaves
    return _CACHE[key]


def _contributions(x: np.ndarray, leaves: list, n_features: int) -> tuple[np.ndarray, float]:
    """Contributions (rows x features) and the base value. Splits are few (a bounded number
    of thresholds a feature, shared by all trees), so each is compared once a batch; what
    a leaf then does is on contiguous columns: bytes for its pattern, one gather a feature."""
    rows = x.shape[0]
    columns = np.ascontiguousarray(x.T)
    goes_left: dict[tuple[int, float], tuple[np.ndarray, np.ndarray]] = {}
    phi = np.zeros((n_features, rows))
    base = 0.0
    for leaf in leaves:
        base += leaf["base"]
        feats = leaf["feats"]
        if not feats:
            continue
        bits: dict[int, np.ndarray] = {}
        for f, thr, left, _ in leaf["path"]:
            if (f, thr) not in goes_left:
                below = columns[f] <= thr  # NaN goes right, as in Spark
                goes_left[f, thr] = (below, ~below)
            side = goes_left[f, thr][0 if left else 1]
            bits[f] = bits[f] & side if f in bits else side
        pattern = np.zeros(rows, dtype=np.uint8 if len(feats) <= 8 else np.int64)
        for k, f in enumerate(feats):
            pattern |= bits[f].astype(pattern.dtype) << pattern.dtype.type(k)
        at = pattern.astype(np.intp)
        for k, f in enumerate(feats):
            phi[f] += np.ascontiguousarray(leaf["table"][:, k]).take(at)
    return np.ascontiguousarray(phi.T), base


def attribute(scored_frame: DataFrame, gbt_model, names: list[str], top_k: int = 5,
              saved_dir: str | None = None) -> DataFrame:
    """Per row: margin, base value, contribution per feature and the top-k by |value|."""
    spark = scored_frame.sparkSession
    bc = spark.sparkContext.broadcast(explain_tables(gbt_model, saved_dir))  # bounded by model size
    n = len(names)
    # a mart is few files, but thousands of leaves a row are work for all cores
    data = scored_frame.select("customer_id", vector_to_array("features").alias("x")).repartition("customer_id")
    schema = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("base_value", T.DoubleType()),
                           T.StructField("margin", T.DoubleType()),
                           T.StructField("contributions", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = bc.value
        for b in batches:
            if b.empty:
                continue
            x = np.vstack(b["x"].to_numpy()).astype(float)
            phi, base = _contributions(x, leaves, n)
            yield pd.DataFrame({"customer_id": b["customer_id"], "base_value": base,
                                "margin": base + phi.sum(axis=1), "contributions": list(phi)})

    out = data.mapInPandas(run, schema)
    pairs = F.arrays_zip(F.array(*[F.lit(nm) for nm in names]).alias("feature"),
                         F.col("contributions").alias("contribution"))
    ranked = F.slice(F.sort_array(F.transform(pairs, lambda p: F.struct(
        F.abs(p["contribution"]).alias("abs_contribution"), p["feature"].alias("feature"),
        p["contribution"].alias("contribution"))), asc=False), 1, top_k)
    return out.withColumn("top_features", F.transform(ranked, lambda r: F.struct(r["feature"].alias("feature"),
                                                                                   r["contribution"].alias("contribution"))))


def global_importance(attributions: DataFrame, names: list[str], top_k: int = 10) -> DataFrame:
    """Mean |contribution| per feature, ranked (one pass: per-feature sums in one agg)."""
    g = attributions.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"f{i}") for i in range(len(names))])
    args = ", ".join(f"'{nm}', f{i}" for i, nm in enumerate(names))
    long = g.select(F.expr(f"stack({len(names)}, {args}) AS (feature, mean_abs_contribution)"))
    w = Window.orderBy(F.col("mean_abs_contribution").desc(), F.col("feature"))  # over <= features rows
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
