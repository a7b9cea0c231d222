"""Calibrated ensembles: folds, fit, save and load, metrics and gates."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators import metrics as MT
from tidemark.operators import models as MD

SMALL = dict(maxIter=4, maxDepth=3, stepSize=0.3, seed=1)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 1.0).astype(float)
    df = spark.createDataFrame([(f"c{i:04d}", float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))],
                               "customer_id string, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_every_fold_has_its_share_of_both_labels(frame):
    n = frame.groupBy("label").count().collect()
    got = MD.folds(frame).groupBy("fold", "label").count().collect()
    for r in n:
        sizes = [g["count"] for g in got if g["label"] == r["label"]]
        assert len(sizes) == MD.N_FOLDS and max(sizes) - min(sizes) <= 1 and sum(sizes) == r["count"]


def test_fit_calibrate_save_score_and_gates(spark, frame, tmp_path):
    model = MD.fit_calibrated(frame, SMALL, k=3)
    model.save(str(tmp_path / "m"))
    loaded = MD.CalibratedGBT.load(str(tmp_path / "m"), k=3)
    a = {r["customer_id"]: r["probability_calibrated"] for r in model.predict(frame).collect()}
    scored = loaded.predict(frame)
    assert all(abs(r["probability_calibrated"] - a[r["customer_id"]]) < 1e-12 for r in scored.collect())
    t = scored.select("customer_id", "label", F.col("probability_calibrated").alias("score"))
    auc, brier = MT.auc(t).first()["auc"], MT.brier(t).first()["brier"]
    assert auc > 0.85 and brier < 0.15
    gate = MT.accuracy_gate(spark.createDataFrame([(auc, brier)], "auc double, brier double"), 0.8, 0.15).first()
    assert gate["auc_passed"] and gate["brier_passed"]


def test_auc_matches_pairs(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 20, 150) / 20, rng.integers(0, 2, 150)
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(s, y) if u for b, v in zip(s, y) if not v]
    got = MT.auc(spark.createDataFrame([(f"c{i}", float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "customer_id string, score double, label int")).first()
    assert abs(got["auc"] - np.mean(pairs)) < 1e-8


def test_fit_tasks_follow_the_cores():
    """Tasks of a tree level are those that the cores take, not one for each so many rows."""
    assert MD.fit_partitions(13_000, 12, 6) == 1  # small data: one task, as ever
    assert MD.fit_partitions(530_000, 12, 6) == 4
    assert MD.fit_partitions(3_200_000, 12, 6) == 4
    assert MD.fit_partitions(3_200_000, 600, 6) == 33  # no tiny tasks
    assert MD.fit_partitions(100_000_000, 12, 6) == 51  # nor boundless ones


def test_scoring_takes_all_cores(spark, frame, tmp_path):
    """Rows of few files are dealt out before the trees are evaluated."""
    model = MD.fit_calibrated(frame, dict(SMALL, maxIter=1), k=2)
    plan = model.predict(frame.coalesce(1)).select("customer_id", "probability_calibrated")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [customer_id" in plan
