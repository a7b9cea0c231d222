"""Regression numbers of the adapter at sf0.01 (FIXTURES.md)."""

import datetime as dt
import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.plans.warehouse import warehouse
from tidemark.sources import adapter

from .conftest import SF001


def test_adapter_counts(spark):
    w = warehouse(spark, SF001)
    assert w.customers.count() == 1349
    assert w.usage_events.count() == 22878
    assert w.usage_events.select("event_id").distinct().count() == 22878
    assert w.support_tickets.count() == 7621
    assert w.support_tickets.where(F.col("resolution_time").isNull()).count() == 158
    assert w.gtm_opportunities.count() == 4532
    assert w.expansion_outreach_log.count() == 678
    tiers = {r[0]: r[1] for r in w.risk_scores.groupBy("risk_tier").count().collect()}
    assert tiers == {"low": 296, "medium": 398, "high": 335, "critical": 113}


def _raw_tables(spark, folder):
    """Orders and lines with repeated and null keys, a customer without orders and orders without customer."""
    day = lambda n: dt.datetime(1995, 1, 1) + dt.timedelta(days=n)
    orders = [(k, [1, 1, 1, 2, 3, 9, None][k % 7], day(k)) for k in range(40)] + [(3, 2, day(3)), (None, 1, day(5))]
    lines = [(k % 45, k, k % 3, 1 + k % 4, float(k % 50), day(10 * k)) for k in range(150)] + [(None, 1, 1, 1, 5.0, day(1)), (7, None, 1, 1, None, day(2))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp") \
        .write.parquet(f"{folder}/lineitem.parquet")
    start = dt.date(1990, 1, 1)
    custs = [("1", start, None), ("2", start, dt.date(1998, 1, 1)), ("2", start, None), ("3", dt.date(1998, 7, 1), None), ("4", start, None), (None, start, None)]
    return orders, lines, custs, spark.createDataFrame(custs, "customer_id string, signup_date date, churn_date date")


def test_usage_events_of_repeated_and_null_keys(spark, tmp_path):
    orders, lines, custs, df = _raw_tables(spark, tmp_path)
    as_of = K.ORDERS_AS_OF
    want = Counter()
    for (lk, part, *_, shipped), (ok, owner, _), (c, signup, churn) in itertools.product(lines, orders, custs):
        if lk is None or lk != ok or c is None or str(owner) != c or shipped.date() >= as_of:
            continue
        d = as_of - dt.timedelta(days=(as_of - shipped.date()).days // K.TIME_COMPRESSION)
        if signup <= d and (churn is None or d <= churn):
            want[c, d, part] += 1
    got = adapter.usage_events(spark, str(tmp_path), df)
    part = F.split("event_id", "-")
    whole = got.where(F.size(part) == 5).select("customer_id", F.to_date("timestamp"), part[2].cast("long")).collect()
    assert Counter(map(tuple, whole)) == Counter({k: n for k, n in want.items() if k[2] is not None})
    assert got.count() == sum(want.values()) > 100


def test_lines_are_shuffled_once_and_by_order(spark, tmp_path):
    """Customers meet the orders first, so the largest table isn't dealt out again by customer."""
    *_, df = _raw_tables(spark, tmp_path)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = adapter.usage_events(spark, str(tmp_path), df)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    depth = lambda line: re.search(r"[A-Z*]", line).start()
    above, held = [], None
    for line in plan:
        above = [x for x in above if depth(x) < depth(line)] + [line]
        if "FileScan" in line and "l_shipdate" in line:
            held = [x for x in above if "Exchange" in x]
    assert held is not None and len(held) == 1 and "l_orderkey" in held[0], plan
