"""A hot key holding a third of the rows must not change any result."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import charts as C
from tidemark.operators import features as FT


def test_event_aggregates_with_hot_customer(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = []
    for i in range(3000):
        cid = "hot" if i % 3 == 0 else f"c{i % 97}"
        day = dt.datetime(2001, 7, 1) + dt.timedelta(days=i % 40)
        et = ["integration_connect", "api_call", "report_view", "premium_feature_trial"][i % 4]
        rows.append((cid, day, et, float((i % 10) / 10)))
    ev = spark.createDataFrame(rows, "customer_id string, event_timestamp timestamp, event_type string, "
                                     "feature_adoption_score float").repartition(8)
    refs = ev.select("customer_id").distinct().select(
        "customer_id", F.lit(dt.date(2001, 6, 20)).alias("signup_date"), F.lit(dt.date(2001, 8, 1)).alias("obs_date"))
    got = {r["customer_id"]: r for r in FT.event_aggregates(ev, refs, cut_before_obs=False).collect()}
    pdf = pd.DataFrame(rows, columns=["customer_id", "ts", "event_type", "score"])
    hot = pdf[pdf.customer_id == "hot"]
    assert got["hot"]["total_events"] == len(hot) == 1000
    assert got["hot"]["events_last_30d"] == int((hot.ts >= pd.Timestamp("2001-07-02")).sum())
    assert got["hot"]["retention_signal_count"] == int(hot.event_type.isin(["integration_connect", "api_call"]).sum())
    assert abs(got["hot"]["avg_adoption_score"] - hot.score.astype("float32").astype(float).mean()) < 1e-9


def test_ticket_top_k_with_hot_customer(spark):
    rows = [("hot" if i % 3 == 0 else f"c{i % 50}", str(i), dt.date(2001, 1, 1) + dt.timedelta(days=i % 200),
             ["low", "medium", "high", "critical"][i % 4], "billing", 5) for i in range(3000)]
    t = spark.createDataFrame(rows, "customer_id string, ticket_id string, created_date date, priority string, "
                                    "topic string, resolution_time int")
    out = C.c360_ticket_table(t, dt.date(2001, 8, 1))
    hot = out.where(F.col("customer_id") == "hot").orderBy("ticket_rank").collect()
    assert len(hot) == 20 and all(r["priority"] == "critical" for r in hot)
    exp = sorted([r for r in rows if r[0] == "hot" and r[3] == "critical"], key=lambda r: (-r[2].toordinal(), r[1]))[:20]
    assert [r["ticket_id"] for r in hot] == [r[1] for r in exp]


def test_raw_events_are_summed_below_the_exchange_and_scanned_once(spark):
    """The plan: partial aggregate, then exchange, then joins; no join sees raw events."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ev = spark.range(100).selectExpr("cast(id % 3 as string) customer_id", "timestamp'2001-07-01' event_timestamp", "'api_call' event_type",
                                         "cast(0.5 as float) feature_adoption_score")
        refs = spark.createDataFrame([("0", dt.date(2001, 1, 1), dt.date(2001, 8, 1))], "customer_id string, signup_date date, obs_date date")
        plan = FT.event_aggregates(ev, refs, cut_before_obs=False)._jdf.queryExecution().sparkPlan().toString()
        below = plan[plan.index("Join"):]
        assert below.count("Range (") == 1 and below.index("partial_count") < below.index("Range (")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_rollup_is_pruned_by_day(spark):
    from tidemark.functions import constants as K
    from tidemark.operators import risk
    from tidemark.plans.warehouse import warehouse
    from tests.conftest import SF0001
    w = warehouse(spark, SF0001, K.ORDERS_AS_OF)
    plan = risk.usage_decay(w.customers, w.event_days, K.ORDERS_AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan


def test_a_table_of_customers_is_not_broadcast_by_its_size(spark, tmp_path):
    """Files under Spark's own 10 MB may hold very many rows: such a table is shuffled,
    in every registered query; a mark in the code still broadcasts."""
    from pyspark.sql import functions as F

    from tidemark.plans import catalog
    for name in ("left", "right"):
        spark.range(400_000).select(F.md5(F.col("id").cast("string")).substr(1, 16).alias("customer_id"), F.lit(name).alias(name)).coalesce(1).write.parquet(str(tmp_path / name))

    def plan(s, d, hint=lambda df: df):
        left, right = s.read.parquet(f"{d}/left"), s.read.parquet(f"{d}/right")
        return left.join(hint(right), "customer_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        shuffled = catalog.register("_join")(plan)(spark, str(tmp_path))
        marked = catalog.register("_marked")(lambda s, d: plan(s, d, F.broadcast))(spark, str(tmp_path))
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in marked._jdf.queryExecution().executedPlan().toString()
        assert shuffled.count() == 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        catalog.QUERIES.pop("_join", None), catalog.QUERIES.pop("_marked", None)
