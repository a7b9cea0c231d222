"""Feature sets: the churn and expansion marts and their point-in-time twins.

One idea carries all of them: a mart is a point-in-time set whose observation
date is ``as_of``. ``event_aggregates`` / ``ticket_aggregates`` take a
reference table (customer_id, signup_date, obs_date) and compute every
per-customer window in one ``groupBy(customer_id)``.

Scale notes
* raw events are never joined: ``event_days`` sums them per customer, day and
  type first. Partial aggregation runs below its exchange, so a customer with a
  third of all events leaves each map task as at most one row per day and type;
* the warehouse stores that rollup once, ordered by day, and all feature sets,
  the descriptive features, usage decay and the 360 counts read it, with their
  day filters pushed down to its files;
* the reference side is joined on customer_id and the aggregate keeps that
  partitioning, so aggregate + later joins on customer_id add no exchange.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date


def _days_before(obs: Column, n: int) -> Column:
    return F.date_sub(obs, n)


def event_days(events: DataFrame, ts_col: str = "event_timestamp") -> DataFrame:
    """customer_id, day, event_type, n, n_midnight (at the day's first instant),
    score_sum, score_n: usage events summed per day."""
    score = (F.col("feature_adoption_score") if "feature_adoption_score" in events.columns else F.lit(None)).cast("double")
    return events.groupBy("customer_id", F.to_date(ts_col).alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(ts_col) == F.to_date(ts_col).cast("timestamp")).alias("n_midnight"),
        F.sum(score).alias("score_sum"), F.count(score).alias("score_n"))


def n_if(cond: Column) -> Column:
    """Events (not rows) of a rollup where ``cond`` holds."""
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def mean_score() -> Column:
    return F.sum("score_sum") / F.nullif(F.sum("score_n"), F.lit(0))


def event_aggregates(days: DataFrame, refs: DataFrame, cut_before_obs: bool,
                     retention_types: list[str] | None = None) -> DataFrame:
    """Per-customer event features relative to each customer's ``obs_date``.

    ``days``: the daily rollup (``event_days``), or staged usage events, which are
    rolled up here. ``refs``: customer_id, signup_date, obs_date.
    """
    if "score_n" not in days.columns:
        days = event_days(days)
    retention_types = retention_types or K.RETENTION_EVENT_TYPES
    j = days.withColumnRenamed("day", "_d").join(refs.select("customer_id", "signup_date", "obs_date"), "customer_id", "inner")
    if cut_before_obs:
        j = j.where(F.col("_d") < F.col("obs_date"))
    obs, d, et = F.col("obs_date"), F.col("_d"), F.col("event_type")
    last30 = d >= _days_before(obs, 30)
    return j.groupBy("customer_id", "obs_date").agg(
        F.sum("n").alias("total_events"),
        n_if(last30).alias("events_last_30d"),
        n_if(d >= _days_before(obs, 7)).alias("events_last_7d"),
        mean_score().alias("avg_adoption_score"),
        F.datediff(obs, F.max(d)).alias("days_since_last_event"),
        n_if(et.isin(*retention_types)).alias("retention_signal_count"),
        n_if((et == "integration_connect") & (d <= F.date_add(F.col("signup_date"), 30)))
        .alias("integration_connects_first_30d"),
        n_if((et == "premium_feature_trial") & last30).alias("premium_feature_trials_30d"),
        n_if((et == "feature_limit_hit") & last30).alias("feature_limit_hit_30d"),
    )


def ticket_aggregates(tickets: DataFrame, refs: DataFrame, cut_before_obs: bool) -> DataFrame:
    t = tickets.select("customer_id", F.col("created_date").alias("_d"), "priority", "topic",
                       "resolution_time")
    j = t.join(refs.select("customer_id", "obs_date"), "customer_id", "inner")
    if cut_before_obs:
        j = j.where(F.col("_d") < F.col("obs_date"))
    obs, d = F.col("obs_date"), F.col("_d")
    return j.groupBy("customer_id").agg(
        F.count_if(d >= _days_before(obs, 30)).alias("tickets_last_30d"),
        F.count_if(F.col("priority").isin(*K.HIGH_PRIORITIES)).alias("high_priority_tickets"),
        F.avg("resolution_time").alias("avg_resolution_hours"),
        F.count_if((F.col("topic") == "feature_request") & (d >= _days_before(obs, 90)))
         .alias("feature_request_tickets_90d"),
    )


def opportunity_aggregates(opps: DataFrame) -> DataFrame:
    """Open expansion opportunities per customer (not time-bounded)."""
    is_open_exp = ((F.col("opportunity_type") == "expansion")
                   & ~F.col("stage").isin(*K.CLOSED_STAGES))
    return opps.groupBy("customer_id").agg(
        F.bool_or(is_open_exp).alias("has_open_expansion_opp"),
        F.sum(F.when(is_open_exp, F.col("amount")).otherwise(F.lit(0).cast("decimal(12,2)")))
         .alias("expansion_opp_amount"),
    )


def outreach_aggregates(outreach_stg: DataFrame) -> DataFrame:
    return outreach_stg.groupBy("customer_id").agg(
        F.lit(True).alias("was_contacted"),
        F.min("days_since_outreach").alias("days_since_last_outreach"))


def _recency(tenure: Column) -> Column:
    """No events => inactive for the whole tenure (never a 999 sentinel)."""
    return F.when(F.col("total_events").isNull() | (F.col("total_events") == 0), tenure) \
            .otherwise(F.col("days_since_last_event"))


def _churn_feature_columns(tenure: Column) -> list[Column]:
    return [
        F.coalesce("total_events", F.lit(0)).alias("total_events"),
        F.coalesce("events_last_30d", F.lit(0)).alias("events_last_30d"),
        F.coalesce("events_last_7d", F.lit(0)).alias("events_last_7d"),
        F.coalesce("avg_adoption_score", F.lit(0.0)).alias("avg_adoption_score"),
        _recency(tenure).alias("days_since_last_event"),
        F.coalesce("retention_signal_count", F.lit(0)).alias("retention_signal_count"),
        F.coalesce("integration_connects_first_30d", F.lit(0)).alias("integration_connects_first_30d"),
        F.when(F.coalesce("integration_connects_first_30d", F.lit(0)) >= 3, 1).otherwise(0)
         .alias("activated_at_30d"),
        F.coalesce("tickets_last_30d", F.lit(0)).alias("tickets_last_30d"),
        F.coalesce("high_priority_tickets", F.lit(0)).alias("high_priority_tickets"),
        F.coalesce("avg_resolution_hours", F.lit(0.0)).alias("avg_resolution_hours"),
    ]


def _event_cols():
    return ["customer_id", "total_events", "events_last_30d", "events_last_7d", "avg_adoption_score",
            "days_since_last_event", "retention_signal_count", "integration_connects_first_30d",
            "premium_feature_trials_30d", "feature_limit_hit_30d"]


def mart_churn_features(stg_customers: DataFrame, stg_events: DataFrame, stg_tickets: DataFrame,
                        as_of: _dt.date, active_only: bool = True) -> DataFrame:
    """One row per active customer with the churn features at ``as_of``.

    ``active_only=False`` gives the same features for every customer
    (the from-raw variant, which also serves churned customers).
    """
    base = stg_customers.where(F.col("is_active")) if active_only else stg_customers
    refs = base.select("customer_id", "signup_date", lit_date(as_of).alias("obs_date"))
    ev = event_aggregates(stg_events, refs, cut_before_obs=False)
    tk = ticket_aggregates(stg_tickets, refs, cut_before_obs=False)
    j = (base.join(ev.select(*_event_cols()), "customer_id", "left")
             .join(tk.select("customer_id", "tickets_last_30d", "high_priority_tickets",
                             "avg_resolution_hours"), "customer_id", "left"))
    return j.select("customer_id", "industry", "plan_tier", "mrr", "tenure_days", "is_early_stage",
                    *_churn_feature_columns(F.col("tenure_days")))


def mrr_tier_ceiling_pct(plan_tier: Column, mrr: Column) -> Column:
    floor = F.lit(0.0)
    ceil = F.lit(1.0)
    for t, (lo, hi) in K.TIER_MRR_BANDS.items():
        floor = F.when(plan_tier == t, F.lit(lo)).otherwise(floor)
        ceil = F.when(plan_tier == t, F.lit(hi)).otherwise(ceil)
    ratio = (mrr.cast("double") - floor) / (ceil - floor)
    return F.when(plan_tier == "free", F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)))


def mart_expansion_features(stg_customers: DataFrame, churn_mart: DataFrame, stg_events: DataFrame,
                            stg_tickets: DataFrame, stg_opps: DataFrame, stg_outreach: DataFrame,
                            as_of: _dt.date, every: bool = False) -> DataFrame:
    """Active, not-yet-upgraded customers: churn features + expansion signals.

    ``every=True`` gives the same features for all customers (the from-raw
    variant; ``churn_mart`` must then hold all customers too).
    """
    base = stg_customers if every else stg_customers.where(F.col("is_active") & ~F.col("is_upgraded"))
    refs = base.select("customer_id", "signup_date", lit_date(as_of).alias("obs_date"))
    # only the last 30 days matter here; the rest comes from the churn mart
    days = stg_events if "score_n" in stg_events.columns else event_days(stg_events)
    days = days.where(F.col("day") >= _days_before(lit_date(as_of), 30))
    ev = event_aggregates(days, refs, cut_before_obs=False) \
        .select("customer_id", "premium_feature_trials_30d", "feature_limit_hit_30d")
    tk = ticket_aggregates(stg_tickets, refs, cut_before_obs=False) \
        .select("customer_id", "feature_request_tickets_90d")
    op = opportunity_aggregates(stg_opps)
    os_ = outreach_aggregates(stg_outreach)
    cf = churn_mart.drop("industry", "plan_tier", "mrr", "tenure_days", "is_early_stage")
    j = (base.select("customer_id", "industry", "plan_tier", "mrr", "tenure_days", "is_early_stage")
             .join(cf, "customer_id", "inner")
             .join(ev, "customer_id", "left").join(tk, "customer_id", "left")
             .join(op, "customer_id", "left").join(os_, "customer_id", "left"))
    return j.select(
        "customer_id", "mrr", "tenure_days", "is_early_stage", "total_events", "events_last_30d",
        "events_last_7d", "avg_adoption_score", "days_since_last_event", "retention_signal_count",
        "integration_connects_first_30d", "activated_at_30d", "tickets_last_30d",
        "high_priority_tickets", "avg_resolution_hours", "plan_tier", "industry",
        F.coalesce("premium_feature_trials_30d", F.lit(0)).alias("premium_feature_trials_30d"),
        F.coalesce("feature_request_tickets_90d", F.lit(0)).alias("feature_request_tickets_90d"),
        F.coalesce("has_open_expansion_opp", F.lit(False)).alias("has_open_expansion_opp"),
        F.coalesce("expansion_opp_amount", F.lit(0).cast("decimal(12,2)")).alias("expansion_opp_amount"),
        mrr_tier_ceiling_pct(F.col("plan_tier"), F.col("mrr")).alias("mrr_tier_ceiling_pct"),
        F.coalesce("feature_limit_hit_30d", F.lit(0)).alias("feature_limit_hit_30d"),
        F.coalesce("was_contacted", F.lit(False)).alias("was_contacted"),
        "days_since_last_outreach",
    )


def _pit_refs(customers: DataFrame, obs_source: str, as_of: _dt.date) -> DataFrame:
    obs = F.coalesce(F.col(obs_source), lit_date(as_of))
    return customers.select(
        "customer_id", "industry", "plan_tier", "mrr", F.col("signup_date").cast("date").alias("signup_date"),
        F.when(F.col(obs_source).isNotNull(), 1).otherwise(0).alias("label"),
        obs.alias("obs_date"),
        F.datediff(obs, F.col("signup_date")).alias("tenure_days"))


def train_churn_pit(customers: DataFrame, events_stg: DataFrame, tickets: DataFrame,
                    as_of: _dt.date) -> DataFrame:
    """Point-in-time churn training set: obs_date = churn_date or as_of,
    everything strictly before obs_date, windows relative to obs_date."""
    refs = _pit_refs(customers, "churn_date", as_of)
    ev = event_aggregates(events_stg, refs, cut_before_obs=True)
    tk = ticket_aggregates(tickets, refs, cut_before_obs=True)
    j = (refs.join(ev.select(*_event_cols()), "customer_id", "left")
             .join(tk.select("customer_id", "tickets_last_30d", "high_priority_tickets",
                             "avg_resolution_hours"), "customer_id", "left"))
    return j.select("customer_id", "signup_date", "obs_date", "plan_tier", "industry", "mrr", "tenure_days",
                    F.when(F.col("tenure_days") <= K.EARLY_STAGE_DAYS, 1).otherwise(0).alias("is_early_stage"),
                    "label", *_churn_feature_columns(F.col("tenure_days")))


def train_expansion_pit(customers: DataFrame, events_stg: DataFrame, tickets: DataFrame,
                        opps: DataFrame, as_of: _dt.date) -> DataFrame:
    """Point-in-time expansion set: obs_date = upgrade_date or as_of; churned
    customers excluded; opportunities are NOT cut at obs_date (kept as in the
    original, the leakage guard reports it)."""
    refs = _pit_refs(customers.where(F.col("churn_date").isNull()), "upgrade_date", as_of)
    ev = event_aggregates(events_stg, refs, cut_before_obs=True)
    tk = ticket_aggregates(tickets, refs, cut_before_obs=True)
    op = opportunity_aggregates(opps)
    j = (refs.join(ev.select(*_event_cols()), "customer_id", "left")
             .join(tk, "customer_id", "left").join(op, "customer_id", "left"))
    return j.select(
        "customer_id", "signup_date", "obs_date", "plan_tier", "industry", "mrr", "tenure_days",
        F.when(F.col("tenure_days") <= K.EARLY_STAGE_DAYS, 1).otherwise(0).alias("is_early_stage"),
        "label", *_churn_feature_columns(F.col("tenure_days")),
        F.coalesce("premium_feature_trials_30d", F.lit(0)).alias("premium_feature_trials_30d"),
        F.coalesce("feature_request_tickets_90d", F.lit(0)).alias("feature_request_tickets_90d"),
        F.coalesce("has_open_expansion_opp", F.lit(False)).cast("int").alias("has_open_expansion_opp"),
        F.coalesce(F.col("expansion_opp_amount").cast("double"), F.lit(0.0)).alias("expansion_opp_amount"),
        mrr_tier_ceiling_pct(F.col("plan_tier"), F.col("mrr")).alias("mrr_tier_ceiling_pct"),
        F.coalesce("feature_limit_hit_30d", F.lit(0)).alias("feature_limit_hit_30d"),
    )


def train_time_split(df: DataFrame, cutoff: _dt.date = K.TRAIN_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Out-of-time split on signup_date."""
    c = lit_date(cutoff)
    return df.where(F.col("signup_date") < c), df.where(F.col("signup_date") >= c)


def to_model_row(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Booleans -> 0/1, numerics -> double, categories -> lower case."""
    cols = [F.col(c).cast("int").cast("double").alias(c) if dict(df.dtypes)[c] == "boolean"
            else F.col(c).cast("double").alias(c) for c in numeric]
    cats = [F.lower(F.col(c)).alias(c) for c in K.CATEGORICAL_FEATURES]
    keep = [c for c in ("customer_id", "label", "signup_date") if c in df.columns]
    return df.select(*keep, *cols, *cats)
