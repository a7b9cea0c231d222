"""Staging views: typed projections plus derived flags. All take ``as_of``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date


def stg_customers(customers: DataFrame, as_of: _dt.date) -> DataFrame:
    asof = lit_date(as_of)
    return customers.select(
        "customer_id", "industry", "plan_tier",
        F.col("signup_date").cast("date").alias("signup_date"),
        F.col("mrr").cast("decimal(10,2)").alias("mrr"),
        F.col("churn_date").cast("date").alias("churn_date"),
        F.col("churn_date").isNull().alias("is_active"),
        F.datediff(F.coalesce(F.col("churn_date"), asof), F.col("signup_date")).alias("tenure_days"),
        (F.datediff(asof, F.col("signup_date")) <= K.EARLY_STAGE_DAYS).alias("is_early_stage"),
        F.col("upgrade_date").cast("date").alias("upgrade_date"),
        F.col("upgrade_date").isNotNull().alias("is_upgraded"),
    )


def stg_usage_events(events: DataFrame, retention_types: list[str] | None = None) -> DataFrame:
    retention_types = retention_types or K.RETENTION_EVENT_TYPES
    return events.select(
        "event_id", "customer_id",
        F.col("timestamp").cast("timestamp").alias("event_timestamp"),
        "event_type",
        F.col("feature_adoption_score").cast("float").alias("feature_adoption_score"),
        F.col("event_type").isin(*retention_types).alias("is_retention_signal"),
        (F.col("event_type") == "premium_feature_trial").alias("is_premium_trial"),
        (F.col("event_type") == "feature_limit_hit").alias("is_feature_limit_hit"),
    )


def stg_support_tickets(tickets: DataFrame, customers: DataFrame) -> DataFrame:
    c = customers.select("customer_id", F.col("churn_date").alias("_churn"))
    t = tickets.join(c, "customer_id", "left")
    high = F.col("priority").isin(*K.HIGH_PRIORITIES)
    gap = F.datediff(F.col("_churn"), F.col("created_date"))
    return t.select(
        "ticket_id", "customer_id",
        F.col("created_date").cast("date").alias("created_date"),
        "priority", "topic",
        F.col("resolution_time").cast("int").alias("resolution_time"),
        high.alias("is_high_priority"),
        (high & F.col("_churn").isNotNull() & gap.between(0, K.CHURN_SIGNAL_DAYS)).alias("is_churn_signal"),
    )


def stg_gtm_opportunities(opps: DataFrame, customers: DataFrame) -> DataFrame:
    c = customers.select("customer_id", F.col("churn_date").alias("_churn"))
    o = opps.join(c, "customer_id", "left")
    is_open = ~F.col("stage").isin(*K.CLOSED_STAGES)
    return o.select(
        "opp_id", "customer_id", "stage",
        F.col("close_date").cast("date").alias("close_date"),
        F.col("amount").cast("decimal(12,2)").alias("amount"),
        "sales_owner", "opportunity_type",
        is_open.alias("is_open"),
        (is_open & F.col("_churn").isNotNull()).alias("is_expansion_risk"),
        ((F.col("opportunity_type") == "expansion") & is_open).alias("is_open_expansion_opp"),
    )


def stg_risk_signals(signals: DataFrame) -> DataFrame:
    gap = F.col("compliance_gap_score")
    return signals.select(
        "customer_id",
        gap.cast("float").alias("compliance_gap_score"),
        F.col("vendor_risk_flags").cast("int").alias("vendor_risk_flags"),
        # compared in float precision, as the float column is (0.7f >= 0.70 holds)
        F.when(gap >= F.lit(K.GAP_TIER_HIGH).cast("float"), "high")
         .when(gap >= F.lit(K.GAP_TIER_MEDIUM).cast("float"), "medium")
         .otherwise("low").alias("risk_tier"),
    )


def stg_expansion_outreach(outreach: DataFrame, as_of: _dt.date) -> DataFrame:
    return outreach.select(
        "outreach_id", "customer_id",
        F.col("contacted_date").cast("date").alias("contacted_date"),
        F.col("propensity_at_outreach").cast("float").alias("propensity_at_outreach"),
        "outreach_channel", "outcome",
        (F.col("outcome") == "upgraded").alias("is_converted"),
        F.datediff(lit_date(as_of), F.col("contacted_date")).alias("days_since_outreach"),
    )


def adoption_label(score: "F.Column") -> "F.Column":
    """Adoption band of a score in [0, 1]."""
    return (F.when(score < 0.2, "critical").when(score < 0.5, "low")
             .when(score < 0.75, "moderate").otherwise("high"))


def opp_at_risk(opps: DataFrame, as_of: _dt.date) -> DataFrame:
    """Open opportunity whose close date is today or later."""
    return opps.withColumn("is_at_risk", (~F.col("stage").isin(*K.CLOSED_STAGES))
                           & (F.col("close_date") >= lit_date(as_of)))
