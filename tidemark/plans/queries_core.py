"""Raw tables, staging views, marts and the dashboard charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import charts as C
from tidemark.operators import features as FT
from tidemark.plans import oracle_charts as OC
from tidemark.plans.catalog import register, wh
from tidemark.plans.oracle_base import with_ctes

# ------------------------------------------------------------ marts
register("mart_risk_scores", with_ctes("SELECT * FROM mart_risk"))(
    lambda s, d: wh(s, d).risk_scores)
register("mart_churn_features", with_ctes("SELECT * FROM mart_churn"))(
    lambda s, d: wh(s, d).churn_features)
register("mart_expansion_features", with_ctes("SELECT * FROM mart_expansion"))(
    lambda s, d: wh(s, d).expansion_features)
register("quadrant_mart", with_ctes("SELECT * FROM mart_quadrant"))(
    lambda s, d: wh(s, d).propensity_quadrant)

# ------------------------------------------------------------ charts over the risk mart
_R = lambda s, d: wh(s, d).risk_scores

for _name in ["heat_tier_industry", "heat_tier_share", "heat_arr_by_plan", "heat_industry_rate",
              "heat_kpi_row", "heat_score_histogram", "c360_header", "c360_flag_unpivot",
              "drill_scatter", "drill_usage_funnel", "drill_ticket_load", "drill_onboarding_tier",
              "uplift_cumulative", "uplift_top_n_roi", "uplift_segments", "uplift_kpi",
              "uplift_early_stage"]:
    register(_name, with_ctes(OC.CHARTS[_name]))(
        (lambda fn: (lambda s, d: fn(_R(s, d))))(getattr(C, _name)))

register("c360_weekly_usage", with_ctes(OC.CHARTS["c360_weekly_usage"]))(
    lambda s, d: C.c360_weekly_usage(wh(s, d).stg_usage_events(), K.ORDERS_AS_OF))
register("c360_ticket_table", with_ctes(OC.CHARTS["c360_ticket_table"]))(
    lambda s, d: C.c360_ticket_table(wh(s, d).support_tickets, K.ORDERS_AS_OF))
register("c360_next_opp", with_ctes(OC.CHARTS["c360_next_opp"]))(
    lambda s, d: C.c360_next_opp(wh(s, d).gtm_opportunities, K.ORDERS_AS_OF))
register("drill_at_risk_table", with_ctes(OC.CHARTS["drill_at_risk_table"]))(
    lambda s, d: C.drill_at_risk_table(wh(s, d).risk_scores, wh(s, d).gtm_opportunities))

# ------------------------------------------------------------ raw tables and staging views
from tidemark.functions.columns import lit_date  # noqa: E402
from tidemark.operators import lookups as L  # noqa: E402
from tidemark.operators import quality as Q  # noqa: E402
from tidemark.operators import risk as RK  # noqa: E402
from tidemark.operators import scoring as SC  # noqa: E402
from tidemark.plans import oracle_misc as OM  # noqa: E402
from tidemark.plans import oracle_quality as OQ  # noqa: E402
from tidemark.sources.adapter import event_stream_as_usage  # noqa: E402

for _t in ["customers", "usage_events", "support_tickets", "gtm_opportunities", "risk_signals",
           "expansion_outreach_log"]:
    register(f"raw_{_t}", with_ctes(f"SELECT * FROM raw_{_t}"))(
        (lambda t: (lambda s, d: getattr(wh(s, d), t)))(_t))

for _t in ["stg_customers", "stg_usage_events", "stg_support_tickets", "stg_gtm_opportunities",
           "stg_risk_signals", "stg_expansion_outreach"]:
    register(_t, with_ctes(f"SELECT * FROM {_t}"))((lambda t: (lambda s, d: getattr(wh(s, d), t)()))(_t))


def _tables(s, d):
    w = wh(s, d)
    return {t: getattr(w, t) for t in w.RAW_TABLES}


def _misc(name):
    body, extra = OM.MISC[name]
    return with_ctes(body, extra)


register("src_row_audit", _misc("src_row_audit"))(lambda s, d: L.row_audit({
    **_tables(s, d), "mart_customer_churn_features": wh(s, d).churn_features,
    "mart_customer_risk_scores": wh(s, d).risk_scores,
    "mart_customer_expansion_features": wh(s, d).expansion_features,
    "mart_propensity_quadrant": wh(s, d).propensity_quadrant}))
OQ_ROW_COUNT = with_ctes(OQ.ROW_COUNT_SQL)
register("dq_contracts", with_ctes(OQ.contract_report_sql()))(lambda s, d: Q.contract_report(_tables(s, d), wh(s, d).event_days))
# fixed here: a row of risk signals a customer; no table empty, and at least an event a customer
register("dq_row_count", OQ_ROW_COUNT)(lambda s, d: Q.row_counts(_tables(s, d), {"risk_signals": "customers"}, {
    "customers": 1, "usage_events": "customers", "support_tickets": 1, "gtm_opportunities": 1, "expansion_outreach_log": 1}))
register("dq_rate_in_band", with_ctes(OQ.RATE_BANDS_SQL))(
    lambda s, d: Q.rate_bands(wh(s, d).customers, wh(s, d).expansion_outreach_log))
register("dq_freshness", _misc("dq_freshness"))(
    lambda s, d: Q.freshness(wh(s, d).customers, "signup_date", K.ORDERS_AS_OF))

# ------------------------------------------------------------ lookups (whole-table)
_ASOF_TS = L.as_of_ts(K.ORDERS_AS_OF)
register("lkp_active_by_mrr", _misc("lkp_active_by_mrr"))(lambda s, d: L.active_by_mrr(wh(s, d).customers))
register("lkp_open_opps", _misc("lkp_open_opps"))(lambda s, d: L.open_opportunities(wh(s, d).gtm_opportunities))
register("lkp_events_since", _misc("lkp_events_since"))(
    lambda s, d: L.events_since(wh(s, d).usage_events, _ASOF_TS - __import__("datetime").timedelta(days=14)))
register("lkp_customer_by_id", _misc("lkp_customer_by_id"))(
    lambda s, d: L.customers_by_ids(wh(s, d).customers,
                                    wh(s, d).risk_scores.where(F.col("risk_tier") == "critical")))
register("lkp_event_count_n_days", _misc("lkp_event_count_n_days"))(
    lambda s, d: L.event_count_n_days(wh(s, d).customers, wh(s, d).usage_events, _ASOF_TS, 30))
register("lkp_sample_n", with_ctes("SELECT * FROM raw_customers ORDER BY md5('42-' || customer_id), customer_id LIMIT 100"))(lambda s, d: L.sample_n(wh(s, d).customers, 100))

# ------------------------------------------------------------ risk rules and scoring tables
register("usage_decay", _misc("usage_decay"))(
    lambda s, d: RK.usage_decay(wh(s, d).customers, wh(s, d).event_days, K.ORDERS_AS_OF))


def _composite(s, d):
    w = wh(s, d)
    return RK.risk_composite(RK.usage_decay(w.customers, w.event_days, K.ORDERS_AS_OF), w.risk_signals)


register("risk_composite", _misc("risk_composite"))(_composite)
register("risk_simple_tier", _misc("risk_simple_tier"))(
    lambda s, d: RK.risk_simple_tier(wh(s, d).stg_customers(), wh(s, d).stg_risk_signals()))
register("churn_actions", _misc("churn_actions"))(lambda s, d: SC.churn_actions(wh(s, d).risk_scores))
register("expansion_scoring", _misc("expansion_scoring"))(
    lambda s, d: SC.expansion_scoring(wh(s, d).propensity_quadrant))
register("customer_360_table", _misc("customer_360_table"))(
    lambda s, d: SC.customer_360_table(wh(s, d).risk_scores, wh(s, d).propensity_quadrant, _composite(s, d),
                                       wh(s, d).event_days, wh(s, d).support_tickets,
                                       wh(s, d).gtm_opportunities, K.ORDERS_AS_OF))

# ------------------------------------------------------------ event-only operators (driver `events`)
_EV_TS = L.as_of_ts(K.EVENTS_AS_OF)


def _ev(s, d):
    return event_stream_as_usage(s, d)


register("events_usage_decay", _misc("events_usage_decay"))(
    lambda s, d: RK.usage_decay(_ev(s, d).select("customer_id").distinct(), FT.event_days(_ev(s, d), "timestamp"), K.EVENTS_AS_OF))
register("events_count_n_days", _misc("events_count_n_days"))(
    lambda s, d: L.event_count_n_days(_ev(s, d).select("customer_id").distinct(), _ev(s, d), _EV_TS, 7))


def _events_weekly(s, d):
    e = _ev(s, d).withColumnRenamed("timestamp", "event_timestamp") \
        .withColumnRenamed("value", "feature_adoption_score")
    out = C.c360_weekly_usage(e, K.EVENTS_AS_OF)
    return out.withColumnRenamed("avg_adoption", "avg_value")


register("events_weekly_usage", _misc("events_weekly_usage"))(_events_weekly)

# ------------------------------------------------------------ small domain rules as table jobs
from tidemark.operators import staging as STG  # noqa: E402


def _non_empty(s, d):
    """One flag per mart; each side reads at most one row (limit(1))."""
    w = wh(s, d)
    marts = {"mart_customer_churn_features": w.churn_features, "mart_customer_risk_scores": w.risk_scores,
             "mart_customer_expansion_features": w.expansion_features, "mart_propensity_quadrant": w.propensity_quadrant}
    parts = [df.limit(1).select(F.lit(n).alias("mart")) for n, df in marts.items()]
    present = parts[0]
    for p in parts[1:]:
        present = present.unionByName(p)
    names = s.createDataFrame([(n,) for n in marts], "mart string")
    return names.join(present.withColumn("non_empty", F.lit(True)), "mart", "left") \
        .select("mart", F.coalesce("non_empty", F.lit(False)).alias("non_empty"))


register("dq_mart_non_empty", with_ctes("""SELECT 'mart_customer_churn_features' AS mart, (SELECT count(*) FROM mart_churn) > 0 AS non_empty
UNION ALL SELECT 'mart_customer_risk_scores', (SELECT count(*) FROM mart_risk) > 0
UNION ALL SELECT 'mart_customer_expansion_features', (SELECT count(*) FROM mart_expansion) > 0
UNION ALL SELECT 'mart_propensity_quadrant', (SELECT count(*) FROM mart_quadrant) > 0"""))(_non_empty)
register("dom_adoption_label", with_ctes("""SELECT customer_id, avg_adoption_score,
       CASE WHEN avg_adoption_score < 0.2 THEN 'critical' WHEN avg_adoption_score < 0.5 THEN 'low'
            WHEN avg_adoption_score < 0.75 THEN 'moderate' ELSE 'high' END AS adoption_label,
       avg_adoption_score < 0.5 AS is_low_adoption FROM mart_churn"""))(
    lambda s, d: wh(s, d).churn_features.select(
        "customer_id", "avg_adoption_score", STG.adoption_label(F.col("avg_adoption_score")).alias("adoption_label"),
        (F.col("avg_adoption_score") < 0.5).alias("is_low_adoption")))
register("dom_opp_at_risk", with_ctes(f"""SELECT opp_id, customer_id, stage, close_date,
       stage NOT IN ('closed_won', 'closed_lost') AND close_date >= DATE '{K.ORDERS_AS_OF.isoformat()}' AS is_at_risk
FROM raw_gtm_opportunities"""))(
    lambda s, d: STG.opp_at_risk(wh(s, d).gtm_opportunities, K.ORDERS_AS_OF).select(
        "opp_id", "customer_id", "stage", "close_date", "is_at_risk"))
