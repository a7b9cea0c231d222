"""Risk scoring and segmentation.

The rule score is computed in exact decimals (``F.expr`` with decimal
literals) so tier thresholds such as ``>= 0.50`` are exact; ``F.lit(0.1)``
would be a double.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date, tier


def risk_flags(features: DataFrame) -> DataFrame:
    """Nine boolean risk flags on top of the churn feature mart."""
    c = F.col
    return features.select(
        "*",
        (c("events_last_30d") < 5).alias("flag_very_low_events"),
        (c("events_last_7d") == 0).alias("flag_zero_recent_events"),
        (c("avg_adoption_score") < 0.25).alias("flag_low_adoption"),
        (c("days_since_last_event") > 14).alias("flag_inactive_2w"),
        (c("high_priority_tickets") >= 2).alias("flag_high_support_load"),
        (c("tickets_last_30d") >= 5).alias("flag_ticket_surge"),
        (c("is_early_stage") & (c("events_last_30d") < 3)).alias("flag_early_stage_at_risk"),
        ((c("integration_connects_first_30d") < 3) & (c("tenure_days") <= 90)).alias("flag_low_onboarding"),
        (c("retention_signal_count") == 0).alias("flag_no_retention_signals"),
    )


def _flag_count() -> Column:
    total = F.lit(0)
    for name, _, _ in K.RISK_FLAGS:
        total = total + F.col(name).cast("int")
    return total


def _score_expr() -> Column:
    terms = " + ".join(f"(CAST({name} AS INT) * {w})" for name, _, w in K.RISK_FLAGS)
    return F.expr(f"least(1.0, greatest(0.0, {K.RISK_BASE_RATE} + {terms}))")


def top_drivers(n: int = 2) -> Column:
    """First ``n`` active named drivers in fixed order, comma-joined ('' if none)."""
    named = [F.when(F.col(name), F.lit(label)) for name, label, _ in K.RISK_FLAGS if label]
    return F.array_join(F.slice(F.array_compact(F.array(*named)), 1, n), ", ")


def mart_risk_scores(churn_features: DataFrame) -> DataFrame:
    """Rule-based churn score, tier, ARR at risk and top drivers per active customer."""
    f = risk_flags(churn_features)
    f = f.withColumn("risk_flag_count", _flag_count()) \
         .withColumn("_score", _score_expr()) \
         .withColumn("arr", F.col("mrr") * 12)
    arr_at_risk = F.round(F.col("arr") * F.col("_score"), 2)
    return f.select(
        "customer_id", "industry", "plan_tier", "mrr", "arr", "tenure_days", "is_early_stage",
        "events_last_30d", "events_last_7d", "avg_adoption_score", "days_since_last_event",
        "retention_signal_count", "integration_connects_first_30d", "tickets_last_30d",
        "high_priority_tickets", "avg_resolution_hours", "risk_flag_count",
        F.round(F.col("_score"), 4).alias("churn_score"),
        tier(F.col("_score")).alias("risk_tier"),
        arr_at_risk.alias("arr_at_risk"),
        F.round(F.col("arr") * F.col("_score") * F.expr("0.10"), 2).alias("intervention_value_10pct"),
        top_drivers(2).alias("top_risk_drivers"),
        *[F.col(name) for name, _, _ in K.RISK_FLAGS],
    )


def risk_simple_tier(stg_customers: DataFrame, stg_signals: DataFrame) -> DataFrame:
    """Alternative risk tier from compliance gap and vendor flags (active customers)."""
    base = stg_customers.where(F.col("is_active")).select("customer_id", "industry", "plan_tier", "mrr")
    s = stg_signals.select("customer_id", "compliance_gap_score", "vendor_risk_flags")
    j = base.join(s, "customer_id", "left")
    g, v = F.col("compliance_gap_score"), F.col("vendor_risk_flags")
    f07, f04 = F.lit(0.7).cast("float"), F.lit(0.4).cast("float")  # float-precision thresholds
    t = (F.when((g >= f07) | (v >= 3), "high").when((g >= f04) | (v >= 1), "medium").otherwise("low"))
    return j.select("customer_id", "industry", "plan_tier", "mrr", "compliance_gap_score",
                    "vendor_risk_flags", t.alias("risk_tier"))


def usage_decay(customers: DataFrame, days: DataFrame, as_of: _dt.date) -> DataFrame:
    """Usage decay per customer: 1 - last30/prev30 (prev window [-60, -30)), 1.0 when prev is 0.

    Starts from the customer table, so customers without events get 1.0. ``days``
    is the daily rollup; only its last 60 days are read.
    """
    asof = lit_date(as_of)
    last30 = F.col("day") >= F.date_sub(asof, 30)
    counts = days.where(F.col("day") >= F.date_sub(asof, 60)).groupBy("customer_id").agg(
        F.coalesce(F.sum(F.when(last30, F.col("n"))), F.lit(0)).alias("events_last_30d"),
        F.coalesce(F.sum(F.when(~last30, F.col("n"))), F.lit(0)).alias("events_prev_30d"))
    j = customers.select("customer_id").join(counts, "customer_id", "left")
    last = F.coalesce("events_last_30d", F.lit(0))
    prev = F.coalesce("events_prev_30d", F.lit(0))
    decay = F.when(prev == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - last.cast("double") / F.greatest(prev, F.lit(1))))
    return j.select("customer_id", last.alias("events_last_30d"), prev.alias("events_prev_30d"),
                    decay.alias("usage_decay_score"))


def composite_score(decay: Column, gap: Column, flags: Column) -> Column:
    """round(.50 decay + .35 gap + .15 min(flags/5, 1), 4)."""
    vendor = F.least(flags.cast("double") / 5.0, F.lit(1.0))
    raw = 0.50 * decay + 0.35 * gap.cast("double") + 0.15 * vendor
    return F.round(raw.cast("decimal(38,10)"), 4).cast("double")


def risk_composite(decay_df: DataFrame, signals: DataFrame) -> DataFrame:
    """Composite risk per customer; missing signals count as 0."""
    j = decay_df.join(signals.select("customer_id", "compliance_gap_score", "vendor_risk_flags"),
                      "customer_id", "left")
    gap = F.coalesce(F.col("compliance_gap_score").cast("double"), F.lit(0.0))
    flags = F.coalesce(F.col("vendor_risk_flags"), F.lit(0))
    score = composite_score(F.col("usage_decay_score"), gap, flags)
    return j.select("customer_id", "usage_decay_score", gap.alias("compliance_gap_score"),
                    flags.alias("vendor_risk_flags"), score.alias("risk_score"),
                    tier(score).alias("risk_tier"))


def requires_action(p: Column) -> Column:
    return p >= 0.5


def churn_action(p: Column) -> Column:
    t = tier(p)
    out = F.lit(K.CHURN_ACTIONS["low"])
    for name in ("medium", "high", "critical"):
        out = F.when(t == name, F.lit(K.CHURN_ACTIONS[name])).otherwise(out)
    return out


def next_tier(plan: Column) -> Column:
    m = F.create_map(*[x for k, v in K.NEXT_TIER.items() for x in (F.lit(k), F.lit(v))])
    return m[plan]


def uplift_multiplier(plan: Column) -> Column:
    m = F.create_map(*[x for k, v in K.UPLIFT_MULTIPLIER.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[plan], F.lit(0.0))


def expected_uplift(plan: Column, mrr: Column, p: Column) -> Column:
    """Probability-weighted net annual uplift, rounded to cents."""
    mult = uplift_multiplier(plan)
    paid = F.round((mrr.cast("double") * 12 * F.greatest(F.lit(0.0), mult - 1) * p).cast("decimal(38,10)"), 2)
    free = F.round((F.lit(K.FREE_TO_STARTER_FLOOR_MRR * 12) * p).cast("decimal(38,10)"), 2)
    return (F.when(plan == "free", free)
             .when(next_tier(plan).isNull() | (mult == 0), F.lit(0))
             .otherwise(paid)).cast("double")


def high_value_target(plan: Column, p: Column, uplift: Column) -> Column:
    t = tier(p)
    return F.when((plan == "free") & (t == "critical"), True).otherwise(
        (uplift > K.HIGH_VALUE_UPLIFT) & t.isin("high", "critical"))


def expansion_action(plan: Column, p: Column, uplift: Column, churn_p: Column | None = None) -> Column:
    """GTM routing text; with a churn probability, the 2x2 conflict matrix decides."""
    nxt = F.coalesce(F.upper(next_tier(plan)), F.lit("UPSELL"))
    if churn_p is not None:
        hc, he = churn_p >= 0.5, p >= 0.5
        dollars = F.format_number(F.round(uplift, 0), 0)
        return (F.when(~hc & he, F.concat(F.lit("Growth Engine — schedule "), nxt,
                                           F.lit(" upgrade conversation. Expected ARR uplift: $"),
                                           dollars, F.lit(".")))
                 .when(hc & he, F.concat(F.lit("Flight Risk — Senior Exec intervention required before any "
                                               "upsell motion. Restore health first, then revisit "),
                                         nxt, F.lit(" migration.")))
                 .when(hc & ~he, F.lit("Retention priority — defer expansion until account health is restored."))
                 .otherwise(F.lit("Stable base — nurture via product-led expansion signals.")))
    t = tier(p)
    return (F.when(t == "critical", F.concat(F.lit("EXPANSION PRIORITY: High intent detected. "
                                                   "Immediate outreach for "), nxt, F.lit(" migration.")))
             .when(t == "high", F.concat(F.lit("NURTURE: Strong usage signals. Highlight "), nxt,
                                         F.lit(" features in next QBR.")))
             .when(t == "medium", F.lit("MONITOR: Early signals detected. Increase feature-adoption marketing."))
             .otherwise(F.lit("STABLE: Maintain current service levels.")))


def quadrant_mart(risk_mart: DataFrame, expansion_mart: DataFrame) -> DataFrame:
    """Churn score x expansion proxy quadrants for every expansion candidate."""
    w = K.QUADRANT_WEIGHTS
    e = expansion_mart.select(
        "customer_id", "plan_tier", "premium_feature_trials_30d", "feature_limit_hit_30d",
        "feature_request_tickets_90d", F.col("has_open_expansion_opp").cast("int").alias("opp"),
        "mrr_tier_ceiling_pct", "was_contacted", "days_since_last_outreach",
        (F.log(1 + F.col("premium_feature_trials_30d")) / F.log(F.lit(11.0))).alias("trial_norm"),
        (F.log(1 + F.col("feature_limit_hit_30d")) / F.log(F.lit(11.0))).alias("limit_norm"),
        (F.log(1 + F.col("feature_request_tickets_90d")) / F.log(F.lit(6.0))).alias("req_norm"))
    r = risk_mart.select("customer_id", F.col("churn_score").alias("churn_probability"), "arr_at_risk", "mrr")
    j = e.join(r, "customer_id", "inner")
    proxy = F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                    w["trial"] * F.least(F.lit(1.0), F.col("trial_norm"))
                    + w["limit"] * F.least(F.lit(1.0), F.col("limit_norm"))
                    + w["request"] * F.least(F.lit(1.0), F.col("req_norm"))
                    + w["opp"] * F.col("opp")
                    + w["ceiling"] * F.col("mrr_tier_ceiling_pct")))
    j = j.withColumn("upgrade_propensity_proxy", proxy)
    cp, up = F.col("churn_probability"), F.col("upgrade_propensity_proxy")
    label = (F.when((cp >= 0.50) & (up >= 0.50), "Flight Risk")
              .when((cp < 0.25) & (up >= 0.50), "Growth Engine")
              .when((cp >= 0.50) & (up < 0.25), "Churn Candidate")
              .otherwise("Stable Base"))
    uplift = F.when(F.col("plan_tier") == "free", 500.0 * 12 * up) \
              .otherwise(F.col("mrr").cast("double") * 12 * up)
    return j.select("customer_id", "churn_probability", "upgrade_propensity_proxy", label.alias("quadrant_label"),
                    "arr_at_risk", "mrr", "plan_tier", uplift.alias("expected_arr_uplift_proxy"),
                    "was_contacted", "days_since_last_outreach")


def flight_risk(churn_p: Column, propensity: Column) -> Column:
    return (churn_p >= 0.5) & (propensity >= 0.5)


def flight_risk_reason(churn_p: Column, propensity: Column) -> Column:
    whole = lambda p: F.round((p * 100).cast("decimal(38,10)"), 0).cast("int")
    return F.when(flight_risk(churn_p, propensity), F.format_string(K.FLIGHT_RISK_REASON, whole(churn_p), whole(propensity)))
