"""Derive the six raw application tables from the driver's order tables.

The mapping is deterministic (see FIXTURES.md §4). Design for scale:

* customers: one ``groupBy(o_custkey)`` over orders (partial aggregation makes
  a hot customer cheap), then one equi-join with ``customer`` on the same key.
  Nothing is broadcast unless AQE measures it under the threshold.
* usage_events: orders ⋈ customers on custkey, then lineitem ⋈ these on orderkey.
  Both are shuffle joins at scale. The lines are shuffled once and by order, so a
  customer with many of them is spread; AQE splits a skewed customer's orders.
* every date filter (``< as_of``) is a plain comparison on the scan column so
  it reaches the parquet reader as a pushed filter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import compress_date, lit_date
from tidemark.sources.driver_tables import read_table


def _ts(as_of: _dt.date):
    return F.lit(_dt.datetime(as_of.year, as_of.month, as_of.day))


def customers(spark: SparkSession, sf_dir: str, as_of: _dt.date = K.ORDERS_AS_OF) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer")
    floor_d = F.date_add(lit_date(K.CUSTOMER_FLOOR_ORIGIN),
                         ((F.col("o_custkey") * K.CUSTOMER_FLOOR_MULT) % K.CUSTOMER_FLOOR_SPAN).cast("int"))
    kept = (orders
            .where(F.col("o_orderdate") < _ts(as_of))
            .select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")
            .where(F.col("d") >= floor_d))
    spans = kept.groupBy("o_custkey").agg(
        F.min("d").alias("first_d"),
        F.max("d").alias("last_d"),
        F.min(F.when(F.col("o_totalprice") > K.UPGRADE_ORDER_PRICE, F.col("d"))).alias("big_d"))
    signup = compress_date(F.col("first_d"), as_of)
    last = compress_date(F.col("last_d"), as_of)
    up = compress_date(F.col("big_d"), as_of)
    spans = spans.select("o_custkey", signup.alias("signup_date"), last.alias("last_d"), up.alias("up_d"))
    churn = F.when((F.col("last_d") < F.date_sub(lit_date(as_of), K.CHURN_GAP_DAYS))
                   & (F.col("last_d") > F.col("signup_date")), F.col("last_d"))
    spans = spans.withColumn("churn_date", churn)
    upgrade = F.when(F.col("churn_date").isNull()
                     & (F.col("up_d") >= F.date_add(F.col("signup_date"), K.UPGRADE_MIN_DAYS)), F.col("up_d"))
    mrr = F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(10,2)")
    joined = spans.join(cust.select("c_custkey", "c_mktsegment", "c_acctbal"),
                        F.col("o_custkey") == F.col("c_custkey"), "inner")
    out = joined.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_mktsegment").alias("industry"),
        mrr.alias("mrr"),
        F.col("signup_date"),
        F.col("churn_date"),
        upgrade.alias("upgrade_date"),
    )
    plan = (F.when(F.col("mrr") <= 0, "free").when(F.col("mrr") < 2000, "starter")
             .when(F.col("mrr") < 8000, "growth").otherwise("enterprise"))
    return out.select("customer_id", "industry", plan.alias("plan_tier"), "signup_date",
                      "mrr", "churn_date", "upgrade_date")


def _customer_bounds(custs: DataFrame) -> DataFrame:
    return custs.select(F.col("customer_id").alias("_cid"), F.col("signup_date").alias("_signup"),
                        F.col("churn_date").alias("_churn"))


def _within_life(d) -> "F.Column":
    return (d >= F.col("_signup")) & (F.col("_churn").isNull() | (d <= F.col("_churn")))


def usage_events(spark: SparkSession, sf_dir: str, custs: DataFrame,
                 as_of: _dt.date = K.ORDERS_AS_OF) -> DataFrame:
    li = (read_table(spark, sf_dir, "lineitem")
          .where(F.col("l_shipdate") < _ts(as_of))
          .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("_cid"))
    owned = orders.join(_customer_bounds(custs), "_cid", "inner")
    j = li.join(owned, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
    d = compress_date(F.col("l_shipdate"), as_of)
    j = j.withColumn("_d", d).where(_within_life(F.col("_d")))
    types = F.array(*[F.lit(t) for t in K.EVENT_TYPES])
    idx = ((F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey")) % len(K.EVENT_TYPES)).cast("int")
    event_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                           F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                           F.date_format(F.col("l_shipdate"), "yyyyMMdd"))
    return j.select(
        event_id.alias("event_id"),
        F.col("_cid").alias("customer_id"),
        F.col("_d").cast("timestamp").alias("timestamp"),
        F.element_at(types, idx + 1).alias("event_type"),
        (F.col("l_quantity") / 50).cast("float").alias("feature_adoption_score"),
    )


def _orders_of_customers(spark: SparkSession, sf_dir: str, custs: DataFrame, as_of: _dt.date,
                         cols: list[str], where=None) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate") < _ts(as_of))
    if where is not None:
        o = o.where(where)
    o = o.select(*cols).withColumn("_cid", F.col("o_custkey").cast("string"))
    return o.join(_customer_bounds(custs), "_cid", "inner")


def support_tickets(spark: SparkSession, sf_dir: str, custs: DataFrame,
                    as_of: _dt.date = K.ORDERS_AS_OF) -> DataFrame:
    o = _orders_of_customers(spark, sf_dir, custs, as_of, ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    created = compress_date(F.col("o_orderdate"), as_of)
    o = o.withColumn("_d", created).where(_within_life(F.col("_d")))
    prio = F.lit("low")
    for src, dst in reversed(list(K.ORDER_PRIORITY_TO_TICKET.items())):
        prio = F.when(F.col("o_orderpriority") == src, dst).otherwise(prio)
    topics = F.array(*[F.lit(t) for t in K.TOPICS])
    res = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None)).otherwise(1 + F.col("o_orderkey") % 72).cast("int")
    return o.select(
        F.col("o_orderkey").cast("string").alias("ticket_id"),
        F.col("_cid").alias("customer_id"),
        F.col("_d").alias("created_date"),
        prio.alias("priority"),
        res.alias("resolution_time"),
        F.element_at(topics, (F.col("o_orderkey") % len(K.TOPICS)).cast("int") + 1).alias("topic"),
    )


def gtm_opportunities(spark: SparkSession, sf_dir: str, custs: DataFrame,
                      as_of: _dt.date = K.ORDERS_AS_OF) -> DataFrame:
    o = _orders_of_customers(spark, sf_dir, custs, as_of,
                             ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"],
                             where=F.col("o_orderkey") % 3 == 0)
    low = F.col("o_orderkey") % 5 < 3
    stage = (F.when(F.col("o_orderstatus") == "F", F.when(low, "closed_won").otherwise("closed_lost"))
              .when(F.col("o_orderstatus") == "P", "proposal")
              .otherwise(F.when(low, "qualification").otherwise("prospecting")))
    return o.select(
        F.col("o_orderkey").cast("string").alias("opp_id"),
        F.col("_cid").alias("customer_id"),
        stage.alias("stage"),
        compress_date(F.col("o_orderdate"), as_of).alias("close_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.concat(F.lit("rep_"), (F.col("o_orderkey") % 20).cast("string")).alias("sales_owner"),
        F.when(F.col("o_orderkey") % 2 == 0, "expansion").otherwise("new_business").alias("opportunity_type"),
    )


def risk_signals(spark: SparkSession, sf_dir: str, custs: DataFrame) -> DataFrame:
    """One row per customer: returned-line share (x1.5, capped) and pending orders.

    Two independent aggregates keyed by customer, each pre-aggregated before the
    join so a hot customer never fans out.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    per_order = (li.groupBy("l_orderkey")
                 .agg(F.count(F.lit(1)).alias("n_lines"),
                      F.count_if(F.col("l_returnflag") == "R").alias("n_returned")))
    lines = (per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
             .groupBy("o_custkey")
             .agg(F.sum("n_lines").alias("n_lines"), F.sum("n_returned").alias("n_returned")))
    pending = (orders.groupBy("o_custkey")
               .agg(F.count_if(F.col("o_orderstatus") == "P").alias("n_pending")))
    c = custs.select("customer_id")
    lines = lines.select(F.col("o_custkey").cast("string").alias("customer_id"), "n_lines", "n_returned")
    pending = pending.select(F.col("o_custkey").cast("string").alias("customer_id"), "n_pending")
    j = c.join(lines, "customer_id", "left").join(pending, "customer_id", "left")
    gap = F.least(F.lit(1.0), F.lit(1.5) * (F.col("n_returned") / F.col("n_lines")))
    return j.select(
        "customer_id",
        F.coalesce(gap, F.lit(0.0)).cast("float").alias("compliance_gap_score"),
        F.coalesce(F.col("n_pending"), F.lit(0)).cast("int").alias("vendor_risk_flags"),
    )


def expansion_outreach_log(spark: SparkSession, sf_dir: str, custs: DataFrame,
                           as_of: _dt.date = K.ORDERS_AS_OF) -> DataFrame:
    o = _orders_of_customers(spark, sf_dir, custs, as_of,
                             ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"],
                             where=(F.col("o_orderpriority") == K.OUTREACH_ORDER_PRIORITY)
                             & (F.col("o_orderkey") % 4 == 0))
    channels = F.array(*[F.lit(c) for c in K.OUTREACH_CHANNELS])
    outcome = (F.when(F.col("o_orderstatus") == "F", "upgraded")
                .when(F.col("o_orderstatus") == "O", "active").otherwise("no_response"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("outreach_id"),
        F.col("_cid").alias("customer_id"),
        compress_date(F.col("o_orderdate"), as_of).alias("contacted_date"),
        ((F.col("o_orderkey") % 100) / 100).cast("float").alias("propensity_at_outreach"),
        F.element_at(channels, (F.floor(F.col("o_orderkey") / 4) % 4).cast("int") + 1).alias("outreach_channel"),
        outcome.alias("outcome"),
    )


def event_stream_as_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` table seen as usage events (user_id = customer_id)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").cast("string").alias("event_id"),
                     F.col("user_id").cast("string").alias("customer_id"),
                     F.col("ts").alias("timestamp"),
                     F.col("event_type"),
                     F.col("value").alias("value"))
