import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidemark.functions import stats as ST
from tidemark.operators import ranking


def test_chi2_sf_known_values():
    assert abs(ST.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(ST.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(ST.chi2_sf(0.0, 3) - 1.0) < 1e-12


def test_t_sf_known_values():
    assert abs(ST.t_sf(2.228138851964932, 10) - 0.025) < 1e-9
    assert abs(ST.t_sf(0.0, 5) - 0.5) < 1e-12
    assert abs(ST.norm_sf(1.959963984540054) - 0.025) < 1e-12


def test_global_positions_match_sort(spark):
    random.seed(7)
    rows = [(i, random.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = {r["id"]: r["pos"] for r in ranking.global_positions(df, [F.col("v"), F.col("id")]).collect()}
    expect = {rid: p for p, (rid, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert got == expect


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 10.0), (4, 30.0), (5, 20.0)], "id long, x double")
    got = {r["id"]: r["x_rank"] for r in ranking.average_ranks(df, "x").collect()}
    assert got == {1: 1.5, 3: 1.5, 2: 3.5, 5: 3.5, 4: 5.0}


def test_ntile_formula(spark):
    n = 10
    df = spark.range(n).withColumn("b", ranking.ntile_from_position(F.col("id"), F.lit(n), 4))
    assert [r["b"] for r in df.orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_exact_quantiles_by_brute_force(spark):
    import numpy as np
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.5, float(rng.randint(0, 50))])) for _ in range(700)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r["n"], *[r[f"q{k}"] for k in range(6)]] for r in ranking.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("a", "b", None, "one"):
        vs = [v for k, v in rows if k == g and v is not None]
        assert got[g][0] == len(vs) and np.allclose(got[g][1:], np.quantile(vs, probs), rtol=1e-14)
    assert set(got) == {"a", "b", None, "one"}
    whole = ranking.exact_quantiles(df, [], "v", [0.3]).first()
    assert abs(whole["q0"] - np.quantile([v for _, v in rows if v is not None], 0.3)) < 1e-12
    assert ranking.exact_quantiles(df.where("v > 1000"), [], "v", [0.5]).first()["q0"] is None


def test_no_percentile_buffer_in_plans(spark):
    from tests.conftest import SF0001
    import __spark_entry__ as E
    for name in ("eda_median_split", "ml_precision_top_decile_rule", "ml_decile_lift_rule"):
        plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString().lower()
        assert "percentile" not in plan and "median(" not in plan


def test_recent_events_from_the_rollup_keep_the_instant(spark):
    """Whole days come from the rollup, the bound's own day is cut at the time of the latest event."""
    from types import SimpleNamespace

    from tidemark.operators import features
    from tidemark.plans.queries_analysis import _recent_events
    start = dt.datetime(2001, 5, 1)
    rows = [(f"c{i % 7}", start + dt.timedelta(hours=5 * i % 2300, minutes=i % 60), "login") for i in range(900)]
    rows += [("c0", None, "login"), ("c9", start, "login")]
    events = spark.createDataFrame(rows, "customer_id string, timestamp timestamp, event_type string")
    for some in (events, events.where("customer_id = 'c9'"), events.where("customer_id = 'none'")):
        got = {r["customer_id"]: r["v"] for r in _recent_events(SimpleNamespace(usage_events=some, event_days=features.event_days(some, "timestamp"))).collect()}
        kept = [(r["customer_id"], r["timestamp"]) for r in some.collect() if r["timestamp"] is not None]
        latest = max((at for _, at in kept), default=None)
        want = {}
        for c, at in kept:
            if at >= latest - dt.timedelta(days=30):
                want[c] = want.get(c, 0) + 1
        assert got == want
