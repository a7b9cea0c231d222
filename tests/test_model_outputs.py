"""Scored tables, gates, baselines and p-values that SQL cannot give, against plain versions."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF0001
from tidemark.functions import constants as K
from tidemark.operators import drift as DR
from tidemark.operators import experiments as EX
from tidemark.operators import metrics as MT
from tidemark.operators import models as MD
from tidemark.operators import survival as SV
from tidemark.plans import queries_analysis as QA
from tidemark.plans import queries_models as QM
from tidemark.plans.catalog import wh
from tidemark.sources import sinks


def plain_logrank(rows):
    """chi2 of the k-group log-rank test: every group counted at risk on every day with an event."""
    names = sorted({g for _, _, g in rows})
    k = len(names)
    gap, cov = np.zeros(k), np.zeros((k, k))
    for t in sorted({d for d, e, _ in rows if e}):
        at_risk = np.array([sum(d >= t and g == x for d, _, g in rows) for x in names], float)
        died = np.array([sum(d == t and e and g == x for d, e, g in rows) for x in names], float)
        n, d = at_risk.sum(), died.sum()
        gap += died - d * at_risk / n
        if n > 1:
            share = at_risk / n
            cov += d * (n - d) / (n - 1) * (np.diag(share) - np.outer(share, share))
    return float(gap[:-1] @ np.linalg.solve(cov[:-1, :-1], gap[:-1]))


def test_logrank_of_three_groups(spark):
    rng = np.random.default_rng(11)
    rows = [(int(1 + rng.exponential(20 + 15 * k)), int(rng.random() < 0.7), name) for k, name in enumerate("abc") for _ in range(60)]
    got = SV.logrank_k(spark.createDataFrame(rows, "duration_days int, event int, plan_tier string"), "plan_tier", ["a", "b", "c"]).first()
    chi2 = plain_logrank(rows)
    assert got["df"] == 2 and abs(got["chi2"] - chi2) < 1e-8 * chi2
    assert abs(got["p_value"] - math.exp(-chi2 / 2)) < 1e-10  # the tail at two degrees of freedom


def test_logrank_of_two_groups_is_the_two_group_test(spark):
    rng = np.random.default_rng(12)
    rows = [(int(1 + rng.exponential(20)), int(rng.random() < 0.7), "ab"[k % 2]) for k in range(80)]
    df = spark.createDataFrame(rows, "duration_days int, event int, plan_tier string")
    got, two = SV.logrank_k(df, "plan_tier", ["a", "b"]).first(), SV.with_chi2_p(SV.logrank_two(df, F.col("plan_tier") == "a", "t")).first()
    assert abs(got["chi2"] - two["chi2"]) < 1e-8 and abs(got["p_value"] - two["p_value"]) < 1e-8
    assert abs(got["p_value"] - math.erfc(math.sqrt(got["chi2"] / 2))) < 1e-10


def test_logrank_query_on_the_table(spark):
    sd = QA._sd(spark, SF0001)
    rows = [(r["duration_days"], int(r["event"]), r["plan_tier"]) for r in sd.select("duration_days", "event", "plan_tier").collect()]
    got = {r["test"]: r for r in E.queries()["surv_logrank_tests"](spark, SF0001).collect()}
    want = plain_logrank(rows)
    assert abs(got["logrank_plan_tier"]["chi2"] - want) < 1e-6 * max(1, want)
    assert got["logrank_plan_tier"]["groups"] == len({t for _, _, t in rows}) and all(0 <= r["p_value"] <= 1 for r in got.values())


def test_power_at_n(spark):
    rates = {r["plan_tier"]: r["baseline_churn_90d"] for r in EX.required_n_by_segment(wh(spark, SF0001).customers, K.ORDERS_AS_OF).collect()}
    got = E.queries()["exp_power_at_n"](spark, SF0001).collect()
    assert {r["plan_tier"] for r in got} == {t for t, p in rates.items() if p > 0.10}
    for r in got:
        p, q = rates[r["plan_tier"]], rates[r["plan_tier"]] - 0.10
        se = math.sqrt((p * (1 - p) + q * (1 - q)) / r["n_per_arm"])
        assert abs(r["power"] - (1 - NormalDist().cdf(NormalDist().inv_cdf(0.95) - 0.10 / se))) < 2e-6
    rate = spark.createDataFrame([(0.3,)], "p double")
    n = rate.select(EX.required_n(F.col("p")).alias("n")).first()["n"]
    reached = rate.select(EX.power_at_n(F.col("p"), n).alias("w")).first()["w"]
    assert abs(reached - 0.80) < 0.01  # the planned size has the planned power


def t_tails(t, df):
    """Two-sided tail of Student's t by Simpson's rule."""
    x = np.linspace(-abs(t), abs(t), 20_001)
    logc = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    y = np.exp(logc - (df + 1) / 2 * np.log1p(x * x / df))
    w = np.ones(len(x))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return 1 - float((w * y).sum() * (x[1] - x[0]) / 3)


def test_point_biserial_p(spark):
    got = E.queries()["eda_point_biserial_p"](spark, SF0001).collect()
    feats = QA._eda(spark, SF0001).toPandas()
    assert len(got) == 5
    for r in got:
        c = np.corrcoef(feats[r["feature"]].astype(float), feats["is_churned"].astype(float))[0, 1]
        assert abs(r["correlation"] - c) < 1e-6 and r["n"] == len(feats)
        if not math.isnan(r["t_stat"]):
            assert abs(r["p_value"] - t_tails(r["t_stat"], r["n"] - 2)) < 1e-8


@pytest.mark.parametrize("auc,brier,passed", [(0.81, 0.10, (True, True, "production")), (0.80, 0.15, (True, True, "production")),
                                              (0.79, 0.15, (False, True, "staging")), (0.90, 0.16, (True, False, "production"))])
def test_gates_at_their_borders(spark, auc, brier, passed):
    got = MT.accuracy_gate(spark.createDataFrame([(auc, brier)], "auc double, brier double"), 0.80, 0.15).first()
    assert (got["auc_passed"], got["brier_passed"], got["stage"]) == passed


def test_whole_baseline_like_numpy(spark, tmp_path):
    train = QA._drift_train(spark, SF0001)
    values = train.select(*[F.col(c).cast("double").alias(c) for c in K.DRIFT_FEATURES]).toPandas()
    got = E.queries()["drift_baseline"](spark, SF0001)
    rows = {r["feature"]: r for r in got.collect()}
    assert set(rows) == set(K.DRIFT_FEATURES)
    for name, r in rows.items():
        x = values[name].dropna().to_numpy()
        counts, edges = np.histogram(x, bins=10)
        assert r["n"] == len(x) and (r["min"], r["max"]) == (x.min(), x.max()) and abs(r["mean"] - x.mean()) < 1e-9 * max(1, abs(x.mean()))
        assert np.allclose(r["bins"], edges, rtol=1e-12, atol=1e-12) and np.allclose(r["hist"], counts / len(x), atol=1e-12)
    sinks.write_json(got, str(tmp_path / "baseline"))
    back = {r["feature"]: r for r in sinks.read_baseline(spark, str(tmp_path / "baseline")).collect()}
    assert all(list(back[f]["bins"]) == list(r["bins"]) and list(back[f]["hist"]) == list(r["hist"]) for f, r in rows.items())


def test_report_as_json(spark, tmp_path):
    base = spark.range(60).selectExpr("cast(id as string) customer_id", "cast(id as double) x", "cast(id % 7 as double) y")
    prod = spark.range(60).selectExpr("cast(id as string) customer_id", "cast(id + 40 as double) x", "cast(id % 7 as double) y")
    stored = DR.baseline(base, ["x", "y"])
    report = DR.drift_report(DR.psi(stored, prod, ["x", "y"]), DR.ks(base, prod, ["x", "y"]), dt.date(2001, 8, 1))
    sinks.write_json(report, str(tmp_path / "report"))
    back = {r["feature"]: r for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert back["x"]["drift_detected"] and not back["y"]["drift_detected"] and back["y"]["has_drift"]
    assert back["y"]["drifted_features"] == ["x"] and back["x"]["checked_at"] == "2001-08-01" and back["x"]["max_psi"] == back["x"]["psi"]


def band(p):
    return "critical" if p >= 0.75 else "high" if p >= 0.5 else "medium" if p >= 0.25 else "low"


def test_batch_scores(spark):
    churn = {r["customer_id"]: r for r in E.queries()["ml_batch_score_churn"](spark, SF0001).collect()}
    mart = wh(spark, SF0001).churn_features
    assert set(churn) == {r[0] for r in mart.select("customer_id").collect()}
    again = QM.churn_model(spark, SF0001).predict(MD.model_frame(mart, QM.CHURN_X, label=None)).collect()
    assert all(abs(churn[r["customer_id"]]["churn_probability"] - r["probability_calibrated"]) < 1e-12 for r in again)
    for r in churn.values():
        assert 0 <= r["churn_probability"] <= 1 and r["requires_action"] == (r["churn_probability"] >= 0.5) and r["scored_at"] == K.ORDERS_AS_OF.isoformat()
    tiers = sorted((r["churn_probability"], r["risk_tier"]) for r in churn.values())
    assert all(t == band(p) for p, t in tiers)
    total = E.queries()["ml_batch_score_churn_summary"](spark, SF0001).first()
    assert total["n_scored"] == len(churn) and abs(total["mean_probability"] - np.mean([p for p, _ in tiers])) < 1e-9
    expansion = E.queries()["ml_batch_score_expansion"](spark, SF0001).collect()
    emart = {r["customer_id"]: r for r in wh(spark, SF0001).expansion_features.select("customer_id", "plan_tier").collect()}
    assert len(expansion) == len(emart) and all(r["plan_tier"] == emart[r["customer_id"]]["plan_tier"] for r in expansion)
    assert all(0 <= r["propensity"] <= 1 and r["propensity_tier"] == band(r["propensity"]) for r in expansion)


def test_metadata_and_leakage(spark):
    got = E.queries()["ml_model_metadata"](spark, SF0001).first()
    rows = QA.train_churn(spark, SF0001).select("signup_date", "label").collect()
    train, test = ([r["label"] for r in rows if (r["signup_date"] < K.ORDERS_TRAIN_CUTOFF) == early] for early in (True, False))
    assert (got["n_train"], got["n_test"]) == (len(train), len(test))
    assert abs(got["churn_rate_train"] - np.mean(train)) < 1e-12 and abs(got["churn_rate_test"] - np.mean(test)) < 1e-12
    assert got["features"].split(",") == [*K.CHURN_NUMERIC_FEATURES, "plan_tier", "industry"]
    metrics = E.queries()["ml_metrics_churn"](spark, SF0001).first()
    assert got["auc"] == metrics["auc"] and got["brier"] == metrics["brier"]
    ranked = E.queries()["ml_feature_importance_churn"](spark, SF0001).collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and abs(sum(r["importance"] for r in ranked) - 1) < 1e-9
    assert all(a["importance"] >= b["importance"] for a, b in zip(ranked, ranked[1:]))
    first = E.queries()["ml_leakage_guard"](spark, SF0001).collect()
    assert len(first) == 1 and first[0]["leakage_warning"] == (first[0]["feature"] == "has_open_expansion_opp")


def test_leaking_feature_ranks_first(spark):
    """A feature that tells the label takes the first rank of the importances."""
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(6)
    rows = [(f"c{i:03d}", float(v), float(rng.normal()), float(v > 0)) for i, v in enumerate(rng.normal(size=200))]
    df = VectorAssembler(inputCols=["has_open_expansion_opp", "noise"], outputCol="features").transform(
        spark.createDataFrame(rows, "customer_id string, has_open_expansion_opp double, noise double, label double"))
    model = MD.fit_calibrated(df, dict(maxIter=2, maxDepth=2, stepSize=0.3, seed=1), k=2)
    assert MD.feature_importance(model, ["has_open_expansion_opp", "noise"]).where("rank = 1").first()["feature"] == "has_open_expansion_opp"
