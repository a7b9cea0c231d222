import itertools
import math

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import attribution as AT


def test_shapley_table_matches_enumeration():
    b = np.array([0.3, 0.6, 0.5])
    t = AT._shapley_table(3, b, 2.0)
    for pat in range(8):
        a = np.array([(pat >> k) & 1 for k in range(3)], dtype=float)

        def g(S):
            return 2.0 * np.prod([a[j] if j in S else b[j] for j in range(3)])
        for i in range(3):
            others = [j for j in range(3) if j != i]
            phi = sum(math.factorial(len(S)) * math.factorial(3 - len(S) - 1) / 6 * (g(set(S) | {i}) - g(set(S)))
                      for r in range(3) for S in itertools.combinations(others, r))
            assert abs(phi - t[pat, i]) < 1e-12


def test_contributions_add_up_to_margin(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", float(x1), float(x2), float(x3), float(int(x1 + rng.normal() > 0.5)))
            for i, (x1, x2, x3) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "customer_id string, a double, b double, c double, label double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=1).fit(df)
    att = AT.attribute(df, model, ["a", "b", "c"])
    raw = model.transform(df).select("customer_id", vector_to_array("rawPrediction")[1].alias("m"))
    err = att.join(raw, "customer_id").agg(F.max(F.abs(F.col("margin") - F.col("m")))).first()[0]
    assert err < 1e-9


def test_two_saved_models_are_not_mixed_up(spark, tmp_path):
    """Models loaded alternately in one session are each explained by their own trees."""
    import gc

    from pyspark.ml.classification import GBTClassificationModel
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    frames = {}
    for name, label in (("one", x[:, 0] > 0), ("two", x[:, 1] > 0)):
        rows = [(f"c{i}", float(a), float(b), float(y)) for i, ((a, b), y) in enumerate(zip(x, label))]
        df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
            spark.createDataFrame(rows, "customer_id string, a double, b double, label double"))
        GBTClassifier(maxIter=3, maxDepth=2, seed=1).fit(df).save(str(tmp_path / name))
        frames[name] = df
    for _ in range(3):
        for name, feature in (("one", "a"), ("two", "b")):
            model = GBTClassificationModel.load(str(tmp_path / name))
            got = AT.global_importance(AT.attribute(frames[name], model, ["a", "b"], saved_dir=str(tmp_path / name)), ["a", "b"], top_k=1)
            assert got.first()["feature"] == feature
            del model
            gc.collect()


def _plain_contributions(x, leaves, n_features):
    phi, base = np.zeros((x.shape[0], n_features)), 0.0
    for leaf in leaves:
        base += leaf["base"]
        for row in range(x.shape[0]):
            ok = {f: all((x[row, g] <= t) == left for g, t, left, _ in leaf["path"] if g == f) for f in leaf["feats"]}
            at = sum(int(ok[f]) << k for k, f in enumerate(leaf["feats"]))
            for k, f in enumerate(leaf["feats"]):
                phi[row, f] += leaf["table"][at, k]
    return phi, base


def test_a_split_is_compared_once_a_batch():
    """Same contributions, bit for bit, as leaf by leaf and row by row; a threshold that
    many leaves share is compared with its column once."""
    rng = np.random.default_rng(4)

    def tree(depth, cover):
        nodes = []

        def walk(d, c):
            at = len(nodes)
            nodes.append({"value": float(rng.normal()), "cover": c, "feature": -1})
            if d:
                nodes[at].update(feature=int(rng.integers(4)), threshold=float(rng.integers(-2, 3)) / 2)
                nodes[at]["left"], nodes[at]["right"] = walk(d - 1, c * 0.25), walk(d - 1, c * 0.75)
            return at
        walk(depth, cover)
        return nodes
    leaves = [x for d in (0, 1, 5, 5, 5) for x in AT._leaf_tables(tree(d, 64.0), 0.3)]
    x = rng.normal(size=(50, 4))
    x[3, 2] = np.nan
    compared = []

    class Columns(np.ndarray):
        def __le__(self, other):
            compared.append(float(other))
            return np.asarray(self) <= other
    got, base = AT._contributions(x.view(Columns), leaves, 4)
    want, want_base = _plain_contributions(x, leaves, 4)
    assert np.array_equal(np.asarray(got), want) and base == want_base
    assert len(compared) <= 4 * 5  # features x thresholds, not one a leaf and path step
