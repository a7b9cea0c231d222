"""Scoring tables that combine the marts: expansion routing and the 360 view."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import lit_date, tier
from tidemark.operators import risk as R


def expansion_scoring(quadrant: DataFrame, propensity_col: str = "upgrade_propensity_proxy") -> DataFrame:
    """Per expansion candidate: propensity tier, target tier, uplift, target flag, routing text."""
    p, plan = F.col(propensity_col), F.col("plan_tier")
    q = quadrant.withColumn("_uplift", R.expected_uplift(plan, F.col("mrr"), p))
    return q.select(
        "customer_id", "plan_tier", F.col(propensity_col).alias("propensity"), tier(p).alias("propensity_tier"),
        R.next_tier(plan).alias("target_tier"), F.col("_uplift").alias("expected_arr_uplift"),
        R.high_value_target(plan, p, F.col("_uplift")).alias("is_high_value_target"),
        R.expansion_action(plan, p, F.col("_uplift")).alias("recommended_action"),
        R.expansion_action(plan, p, F.col("_uplift"), F.col("churn_probability")).alias("conflict_action"),
        R.flight_risk(F.col("churn_probability"), p).alias("is_flight_risk"))


def churn_actions(risk_mart: DataFrame) -> DataFrame:
    s = F.col("churn_score")
    return risk_mart.select("customer_id", s.alias("churn_probability"), tier(s).alias("risk_tier"),
                            R.requires_action(s).alias("requires_action"), R.churn_action(s).alias("action"))


def customer_360_table(risk_mart: DataFrame, quadrant: DataFrame, composite: DataFrame, days: DataFrame,
                       tickets: DataFrame, opps: DataFrame, as_of: _dt.date) -> DataFrame:
    """One wide row per active customer; each child table is pre-aggregated by
    customer before the joins, so no join fans out."""
    ev30 = days.where(F.col("day") >= F.date_sub(lit_date(as_of), 30)) \
        .groupBy("customer_id").agg(F.sum("n").alias("events_last_30d_raw"))
    open_t = tickets.groupBy("customer_id").agg(F.count_if(F.col("resolution_time").isNull()).alias("open_tickets"))
    last_opp = opps.groupBy("customer_id").agg(
        F.max_by(F.col("stage"), F.struct("close_date", "opp_id")).alias("latest_opportunity_stage"))
    q = quadrant.select("customer_id", F.col("upgrade_propensity_proxy").alias("upgrade_propensity"))
    comp = composite.select("customer_id", F.col("risk_score").alias("composite_risk_score"),
                            F.col("risk_tier").alias("composite_risk_tier"))
    base = risk_mart.select("customer_id", "industry", "plan_tier", "mrr", "tenure_days",
                            F.col("churn_score").alias("churn_probability"))
    j = (base.join(q, "customer_id", "left").join(comp, "customer_id", "left")
             .join(ev30, "customer_id", "left").join(open_t, "customer_id", "left")
             .join(last_opp, "customer_id", "left"))
    cp, up, plan = F.col("churn_probability"), F.col("upgrade_propensity"), F.col("plan_tier")
    uplift = F.when(up.isNotNull(), R.expected_uplift(plan, F.col("mrr"), up))
    return j.select(
        "customer_id", "industry", "plan_tier", "mrr", "tenure_days", "churn_probability",
        tier(cp).alias("churn_risk_tier"), "upgrade_propensity",
        F.when(up.isNotNull(), tier(up)).alias("propensity_tier"),
        R.next_tier(plan).alias("target_tier"), uplift.alias("expected_arr_uplift"),
        F.when(up.isNotNull(), R.high_value_target(plan, up, uplift)).alias("is_high_value_target"),
        F.when(up.isNotNull(), R.expansion_action(plan, up, uplift, cp)).alias("recommended_action"),
        F.coalesce(R.flight_risk(cp, up), F.lit(False)).alias("is_flight_risk"),
        "composite_risk_score", "composite_risk_tier",
        F.coalesce("events_last_30d_raw", F.lit(0)).alias("events_last_30d"),
        F.coalesce("open_tickets", F.lit(0)).alias("open_tickets"),
        F.coalesce("latest_opportunity_stage", F.lit("none")).alias("latest_opportunity_stage"))
