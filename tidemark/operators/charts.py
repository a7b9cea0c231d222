"""Dashboard chart queries over the risk mart (and raw tables for the 360 view).

The single-customer 360 charts are re-aimed at all customers at once: the
customer filter becomes an optional argument, the work becomes one
``groupBy``/window keyed by customer.

Scale notes
* per-customer top-k (`row_number() <= k`) is planned by Spark with a
  partial ``WindowGroupLimit`` before the shuffle, so a hot customer sends at
  most k rows per map task;
* global top-N charts are ``orderBy(...).limit(N)`` (TakeOrderedAndProject:
  per-partition top-N, then merge) and any running window is applied to those
  N rows only, never to the full table;
* every ordered LIMIT gets an id tie-break so results are deterministic.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date, tier_order


def pct1_avg(c: Column) -> Column:
    """round(avg(x) * 100, 1), rounding an exact decimal, as double."""
    return F.round((F.avg(c.cast("double")) * 100).cast("decimal(38,10)"), 1).cast("double")


def round_sum(c: Column, digits: int = 0) -> Column:
    return F.round(F.sum(c), digits).cast("double")


def round_avg(c: Column, digits: int) -> Column:
    return F.round(F.avg(c.cast("double")).cast("decimal(38,10)"), digits).cast("double")


def count_when(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


# ---------------------------------------------------------------- heat map
def heat_tier_industry(r: DataFrame) -> DataFrame:
    return r.groupBy("plan_tier", "industry").agg(
        F.count(F.lit(1)).alias("customer_count"),
        pct1_avg(F.col("churn_score")).alias("avg_churn_score_pct"),
        round_sum(F.col("arr_at_risk")).alias("total_arr_at_risk"),
        count_when(F.col("risk_tier") == "critical").alias("critical_count"),
        count_when(F.col("risk_tier") == "high").alias("high_count"))


def heat_tier_share(r: DataFrame) -> DataFrame:
    """Share of customers and ARR at risk per risk tier (the flagship question)."""
    g = r.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customer_count"),
                                   F.sum("arr_at_risk").alias("_arr"))
    # the total is taken over the <= 4 aggregated rows, not the table
    total = F.sum("customer_count").over(Window.partitionBy())
    pct = F.round((F.col("customer_count") * F.lit(100.0).cast("decimal(4,1)") / total).cast("decimal(38,10)"), 1)
    return g.select("risk_tier", "customer_count", pct.cast("double").alias("pct_of_portfolio"),
                    F.round("_arr", 0).cast("double").alias("arr_at_risk_usd")) \
            .orderBy(tier_order(F.col("risk_tier")))


def heat_arr_by_plan(r: DataFrame) -> DataFrame:
    return r.groupBy("plan_tier", "risk_tier").agg(
        round_sum(F.col("arr_at_risk")).alias("arr_at_risk_usd"),
        F.count(F.lit(1)).alias("customer_count"))


def heat_industry_rate(r: DataFrame) -> DataFrame:
    return r.groupBy("industry").agg(
        F.count(F.lit(1)).alias("total_customers"),
        pct1_avg(F.col("churn_score")).alias("avg_churn_score_pct"),
        count_when(F.col("risk_tier").isin("critical", "high")).alias("at_risk_count"),
        round_sum(F.col("arr_at_risk")).alias("total_arr_at_risk_usd"))


def heat_kpi_row(r: DataFrame) -> DataFrame:
    return r.agg(
        F.count(F.lit(1)).alias("total_active_customers"),
        count_when(F.col("risk_tier").isin("critical", "high")).alias("at_risk_customers"),
        round_sum(F.col("arr_at_risk")).alias("total_arr_at_risk"),
        pct1_avg(F.col("churn_score")).alias("portfolio_avg_churn_pct"),
        round_sum(F.col("mrr")).alias("total_mrr"),
        round_sum(F.col("arr")).alias("total_arr"))


def heat_score_histogram(r: DataFrame) -> DataFrame:
    s = F.col("churn_score")
    bucket = (F.when(s < 0.10, "0–10%").when(s < 0.25, "10–25%").when(s < 0.50, "25–50%")
               .when(s < 0.75, "50–75%").otherwise("75–100%"))
    return r.groupBy(bucket.alias("score_bucket")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        round_sum(F.col("mrr")).alias("mrr_in_bucket"),
        F.min("churn_score").alias("_min")).orderBy("_min").drop("_min")


# ------------------------------------------------------------ customer 360
def _maybe_filter(df: DataFrame, customer_ids: list[str] | None) -> DataFrame:
    return df.where(F.col("customer_id").isin(*customer_ids)) if customer_ids else df


def c360_header(r: DataFrame, customer_ids: list[str] | None = None) -> DataFrame:
    r = _maybe_filter(r, customer_ids)
    return r.select("customer_id",
                    F.round(F.col("churn_score") * 100, 1).cast("double").alias("churn_probability_pct"),
                    "risk_tier", F.round("arr_at_risk", 0).cast("double").alias("arr_at_risk_usd"),
                    F.col("mrr").cast("double").alias("mrr"), "plan_tier", "industry", "top_risk_drivers")


def c360_flag_unpivot(r: DataFrame, customer_ids: list[str] | None = None) -> DataFrame:
    """Seven (driver, active) rows per customer from one scan (stack, not 7 unions)."""
    r = _maybe_filter(r, customer_ids)
    args = ", ".join(f"'{label}', CAST({flag} AS BIGINT)" for flag, label in K.C360_FLAG_LABELS)
    return r.select("customer_id", F.expr(f"stack({len(K.C360_FLAG_LABELS)}, {args}) AS (driver, active)"))


def c360_weekly_usage(events_stg: DataFrame, as_of: _dt.date, customer_ids: list[str] | None = None) -> DataFrame:
    e = _maybe_filter(events_stg, customer_ids)
    e = e.where(F.col("event_timestamp") >= F.date_sub(lit_date(as_of), 90).cast("timestamp"))
    week = F.date_trunc("week", F.to_date("event_timestamp")).cast("date")
    return e.groupBy("customer_id", week.alias("week_start")).agg(
        F.count(F.lit(1)).alias("event_count"),
        round_avg(F.col("feature_adoption_score"), 3).alias("avg_adoption"))


def c360_ticket_table(tickets: DataFrame, as_of: _dt.date, customer_ids: list[str] | None = None,
                      k: int = 20) -> DataFrame:
    t = _maybe_filter(tickets, customer_ids)
    prio = (F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1)
             .when(F.col("priority") == "medium", 2).otherwise(3))
    w = Window.partitionBy("customer_id").orderBy(prio, F.col("created_date").desc(), F.col("ticket_id"))
    t = t.withColumn("ticket_rank", F.row_number().over(w)).where(F.col("ticket_rank") <= k)
    return t.select("customer_id", "ticket_rank", "ticket_id", "created_date", "priority", "topic",
                    F.datediff(lit_date(as_of), F.col("created_date")).cast("long").alias("age_days"),
                    F.when(F.col("resolution_time").isNull(), "Open").otherwise("Resolved").alias("status"))


def c360_next_opp(opps: DataFrame, as_of: _dt.date, customer_ids: list[str] | None = None) -> DataFrame:
    """Earliest-closing open opportunity per customer (min_by: skew-safe, no window)."""
    o = _maybe_filter(opps, customer_ids).where(~F.col("stage").isin(*K.CLOSED_STAGES))
    best = o.groupBy("customer_id").agg(F.min_by(
        F.struct("opp_id", "stage", "amount", "sales_owner", "close_date"),
        F.struct("close_date", "opp_id")).alias("o"))
    return best.select("customer_id", "o.opp_id", "o.stage",
                       F.round("o.amount", 0).cast("double").alias("amount_usd"), "o.sales_owner",
                       "o.close_date",
                       F.datediff(F.col("o.close_date"), lit_date(as_of)).cast("long").alias("days_to_close"))


# ----------------------------------------------------------- drill-down
def latest_open_opp(opps: DataFrame) -> DataFrame:
    """Latest-closing open opportunity per customer (ties: larger opp_id)."""
    o = opps.where(~F.col("stage").isin(*K.CLOSED_STAGES))
    return o.groupBy("customer_id").agg(
        F.max_by(F.struct("stage", "amount", "opp_id", "close_date"),
                 F.struct("close_date", "opp_id")).alias("g")) \
            .select("customer_id", F.col("g.stage").alias("stage"), F.col("g.amount").alias("amount"),
                    F.col("g.opp_id").alias("opp_id"), F.col("g.close_date").alias("close_date"))


def drill_at_risk_table(r: DataFrame, opps: DataFrame, limit: int = 200) -> DataFrame:
    s = F.col("churn_score")
    action = (F.when(s >= 0.75, K.DRILL_ACTIONS["critical"]).when(s >= 0.50, K.DRILL_ACTIONS["high"])
               .when(s >= 0.25, K.DRILL_ACTIONS["medium"]).otherwise(K.DRILL_ACTIONS["low"]))
    top = r.where(F.col("risk_tier").isin("critical", "high")) \
           .orderBy(F.col("arr_at_risk").desc(), F.col("customer_id")).limit(limit)
    # the top-N is bounded by `limit`, so broadcasting its ids is size-safe and
    # cuts the opportunity scan down to those customers before aggregating
    g = latest_open_opp(opps.join(F.broadcast(top.select("customer_id")), "customer_id", "left_semi"))
    j = top.join(g.select("customer_id", F.col("stage").alias("_gs"), F.col("amount").alias("_ga")),
                 "customer_id", "left")
    return j.select(
        "customer_id", "plan_tier", "industry",
        F.round("mrr", 0).cast("double").alias("mrr_usd"), F.round("arr", 0).cast("double").alias("arr_usd"),
        F.round(F.col("churn_score") * 100, 1).cast("double").alias("churn_score_pct"), "risk_tier",
        F.round("arr_at_risk", 0).cast("double").alias("arr_at_risk_usd"), "events_last_30d",
        "avg_adoption_score", "high_priority_tickets", "days_since_last_event", "top_risk_drivers",
        "tenure_days", action.alias("recommended_action"),
        F.coalesce(F.col("_gs"), F.lit("none")).alias("gtm_stage"),
        F.coalesce(F.round("_ga", 0), F.lit(0)).cast("double").alias("gtm_amount_usd"))


def drill_scatter(r: DataFrame, limit: int = 500) -> DataFrame:
    return r.orderBy(F.col("churn_score").desc(), F.col("customer_id")).limit(limit).select(
        "customer_id", F.col("churn_score").cast("double").alias("churn_score"), "events_last_30d",
        "avg_adoption_score", "risk_tier", F.col("mrr").cast("double").alias("mrr"), "plan_tier")


def drill_usage_funnel(r: DataFrame) -> DataFrame:
    e7, e30 = F.col("events_last_7d"), F.col("events_last_30d")
    stage = (F.when(e7 >= 5, "1. Active (5+ events/7d)").when(e7 >= 1, "2. Engaged (1-4 events/7d)")
              .when(e30 >= 1, "3. Declining (0/7d, activity/30d)").otherwise("4. Dormant (0 events in 30d)"))
    return r.groupBy(stage.alias("engagement_stage")).agg(
        F.count(F.lit(1)).alias("customer_count"), pct1_avg(F.col("churn_score")).alias("avg_churn_pct"),
        round_sum(F.col("arr_at_risk")).alias("arr_at_risk_usd"),
        F.min("events_last_7d").alias("_m")).orderBy(F.col("_m").desc_nulls_last()).drop("_m")


def drill_ticket_load(r: DataFrame) -> DataFrame:
    h = F.col("high_priority_tickets")
    b = (F.when(h == 0, "0 HP tickets").when(h == 1, "1 HP ticket").when(h == 2, "2 HP tickets")
          .otherwise("3+ HP tickets"))
    return r.groupBy(b.alias("ticket_bucket")).agg(
        F.count(F.lit(1)).alias("customer_count"), pct1_avg(F.col("churn_score")).alias("avg_churn_score_pct"),
        round_avg(F.col("mrr"), 0).alias("avg_mrr"), F.min(h).alias("_m")).orderBy("_m").drop("_m")


def drill_onboarding_tier(r: DataFrame) -> DataFrame:
    i = F.col("integration_connects_first_30d")
    b = (F.when(i == 0, "0 integrations").when(i < 3, "1-2 integrations").when(i < 6, "3-5 integrations")
          .otherwise("6+ integrations"))
    return r.groupBy(b.alias("onboarding_tier")).agg(
        F.count(F.lit(1)).alias("customer_count"), pct1_avg(F.col("churn_score")).alias("avg_churn_pct"),
        count_when(F.col("is_early_stage")).alias("early_stage_count"), F.min(i).alias("_m")) \
        .orderBy("_m").drop("_m")


# ------------------------------------------------------------------ uplift
def uplift_cumulative(r: DataFrame, limit: int = 500) -> DataFrame:
    """Running recovery by ARR at risk. The top-N is taken FIRST (row number and
    running sums depend only on earlier rows), so the window sees N rows, not
    the table: no single-partition exchange of the full mart."""
    top = r.where(F.col("risk_tier").isin("critical", "high", "medium")) \
           .orderBy(F.col("arr_at_risk").desc(), F.col("customer_id")).limit(limit)
    w = Window.orderBy(F.col("arr_at_risk").desc(), F.col("customer_id"))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = F.col("arr_at_risk")
    return top.select(
        F.row_number().over(w).cast("long").alias("accounts_targeted"), "customer_id", "risk_tier",
        F.round(a, 0).cast("double").alias("arr_at_risk_individual"),
        F.round(F.sum(a).over(run), 0).cast("double").alias("cumulative_arr_at_risk"),
        F.round(F.sum(a * F.expr("0.10")).over(run), 0).cast("double").alias("recoverable_arr_10pct"),
        F.round(F.sum(a * F.expr("0.15")).over(run), 0).cast("double").alias("recoverable_arr_15pct"),
        F.round(F.sum(a * F.expr("0.20")).over(run), 0).cast("double").alias("recoverable_arr_20pct"),
        F.col("mrr").cast("double").alias("mrr"), "plan_tier", F.col("churn_score").cast("double").alias("churn_score"))


def uplift_top_n_roi(r: DataFrame, cohorts: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """Top-N cohorts. Rows beyond the largest cohort are cut before ranking, and the
    cohort table is a 4-row literal, so the range join is 100 x 4."""
    n_max = max(cohorts)
    top = r.where(F.col("risk_tier").isin("critical", "high")) \
           .orderBy(F.col("arr_at_risk").desc(), F.col("customer_id")).limit(n_max)
    ranked = top.withColumn("rank_by_impact", F.row_number().over(
        Window.orderBy(F.col("arr_at_risk").desc(), F.col("customer_id"))))
    spark = r.sparkSession
    b = spark.createDataFrame([(c,) for c in cohorts], "cohort_size int")
    j = ranked.join(F.broadcast(b), F.col("rank_by_impact") <= F.col("cohort_size"))
    a = F.col("arr_at_risk")
    cost = F.col("cohort_size") * 600
    roi = F.round(((F.sum(a * F.expr("0.10")) - F.first(cost)) / F.first(cost) * 100).cast("decimal(38,10)"), 1)
    return j.groupBy("cohort_size").agg(
        round_sum(a).alias("total_arr_at_risk"),
        round_sum(a * F.expr("0.10")).alias("recoverable_10pct"),
        round_sum(a * F.expr("0.15")).alias("recoverable_15pct"),
        round_sum(a * F.expr("0.20")).alias("recoverable_20pct"),
        F.count(F.lit(1)).alias("actual_customer_count"),
        pct1_avg(F.col("churn_score")).alias("avg_churn_score_pct"),
        roi.cast("double").alias("roi_10pct")) \
        .select(F.col("cohort_size").cast("long").alias("top_n_customers"), "total_arr_at_risk",
                "recoverable_10pct", "recoverable_15pct", "recoverable_20pct", "actual_customer_count",
                "avg_churn_score_pct", (F.col("top_n_customers") * 600).cast("long").alias("intervention_cost_usd"),
                "roi_10pct")


def uplift_segments(r: DataFrame, limit: int = 15) -> DataFrame:
    a = F.col("arr_at_risk")
    g = r.where(F.col("risk_tier").isin("critical", "high")).groupBy("plan_tier", "industry").agg(
        F.count(F.lit(1)).alias("at_risk_customers"), F.sum(a).alias("_t"),
        round_sum(a * F.expr("0.15")).alias("recoverable_arr_15pct"),
        pct1_avg(F.col("churn_score")).alias("avg_churn_pct"), round_avg(F.col("mrr"), 0).alias("avg_mrr"))
    g = g.orderBy(F.col("_t").desc(), "plan_tier", "industry").limit(limit)
    return g.select("plan_tier", "industry", "at_risk_customers",
                    F.round("_t", 0).cast("double").alias("total_arr_at_risk"), "recoverable_arr_15pct",
                    "avg_churn_pct", "avg_mrr")


def uplift_kpi(r: DataFrame) -> DataFrame:
    a = F.col("arr_at_risk")
    return r.where(F.col("risk_tier").isin("critical", "high")).agg(
        F.count(F.lit(1)).alias("at_risk_customers"),
        round_sum(a).alias("total_arr_at_risk"),
        round_sum(a * F.expr("0.10")).alias("recoverable_arr_10pct"),
        round_sum(a * F.expr("0.15")).alias("recoverable_arr_15pct"),
        round_sum(a * F.expr("0.20")).alias("recoverable_arr_20pct"),
        F.round((F.sum(a * F.expr("0.15")) / F.lit(30000)).cast("decimal(38,10)"), 1).cast("double")
         .alias("payback_ratio_top50"))


def uplift_early_stage(r: DataFrame) -> DataFrame:
    a = F.col("arr_at_risk")
    return r.where(F.col("risk_tier").isin("critical", "high", "medium")).groupBy("is_early_stage").agg(
        F.count(F.lit(1)).alias("customer_count"), pct1_avg(F.col("churn_score")).alias("avg_churn_pct"),
        round_sum(a).alias("total_arr_at_risk"), round_sum(a * F.expr("0.15")).alias("recoverable_15pct"),
        round_avg(F.col("integration_connects_first_30d"), 1).alias("avg_onboarding_integrations"))
