"""Independent DuckDB SQL for lookups, risk rules, scoring tables and the 360 view."""

from __future__ import annotations

from tidemark.plans.oracle_base import AS_OF, AS_OF_TS

EV_AS_OF = "DATE '2024-01-31'"
EV_AS_OF_TS = "TIMESTAMP '2024-01-31 00:00:00'"


def tier(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.75 THEN 'critical' WHEN {x} >= 0.5 THEN 'high' "
            f"WHEN {x} >= 0.25 THEN 'medium' ELSE 'low' END")


def next_tier(plan: str) -> str:
    return (f"CASE {plan} WHEN 'free' THEN 'starter' WHEN 'starter' THEN 'growth' "
            f"WHEN 'growth' THEN 'enterprise' WHEN 'enterprise' THEN 'custom' END")


def mult(plan: str) -> str:
    return (f"CASE {plan} WHEN 'free' THEN 0.0 WHEN 'starter' THEN 3.0 WHEN 'growth' THEN 5.0 "
            f"WHEN 'enterprise' THEN 1.2 ELSE 0.0 END")


def uplift(plan: str, mrr: str, p: str) -> str:
    return (f"CAST(CASE WHEN {plan} = 'free' THEN round(CAST(6000.0 * {p} AS DECIMAL(38,10)), 2) "
            f"WHEN {next_tier(plan)} IS NULL OR {mult(plan)} = 0 THEN 0 "
            f"ELSE round(CAST(CAST({mrr} AS DOUBLE) * 12 * greatest(0.0, {mult(plan)} - 1) * {p} AS DECIMAL(38,10)), 2) END AS DOUBLE)")


def high_value(plan: str, p: str, up: str) -> str:
    return (f"CASE WHEN {plan} = 'free' AND {tier(p)} = 'critical' THEN TRUE "
            f"ELSE {up} > 10000 AND {tier(p)} IN ('high', 'critical') END")


def action(plan: str, p: str, up: str, cp: str | None = None) -> str:
    nxt = f"coalesce(upper({next_tier(plan)}), 'UPSELL')"
    if cp is not None:
        dollars = f"format('{{:,.0f}}', round({up}, 0))"
        return (f"CASE WHEN NOT ({cp} >= 0.5) AND {p} >= 0.5 THEN 'Growth Engine — schedule ' || {nxt} || "
                f"' upgrade conversation. Expected ARR uplift: $' || {dollars} || '.' "
                f"WHEN {cp} >= 0.5 AND {p} >= 0.5 THEN 'Flight Risk — Senior Exec intervention required before any "
                f"upsell motion. Restore health first, then revisit ' || {nxt} || ' migration.' "
                f"WHEN {cp} >= 0.5 AND NOT ({p} >= 0.5) THEN 'Retention priority — defer expansion until account health is restored.' "
                f"ELSE 'Stable base — nurture via product-led expansion signals.' END")
    t = tier(p)
    return (f"CASE WHEN {t} = 'critical' THEN 'EXPANSION PRIORITY: High intent detected. Immediate outreach for ' || {nxt} || ' migration.' "
            f"WHEN {t} = 'high' THEN 'NURTURE: Strong usage signals. Highlight ' || {nxt} || ' features in next QBR.' "
            f"WHEN {t} = 'medium' THEN 'MONITOR: Early signals detected. Increase feature-adoption marketing.' "
            f"ELSE 'STABLE: Maintain current service levels.' END")


USAGE_DECAY_CTE = f"""
ud_counts AS (
  SELECT customer_id,
         count(*) FILTER (WHERE CAST("timestamp" AS DATE) >= {AS_OF} - 30) AS events_last_30d,
         count(*) FILTER (WHERE CAST("timestamp" AS DATE) >= {AS_OF} - 60 AND CAST("timestamp" AS DATE) < {AS_OF} - 30) AS events_prev_30d
  FROM raw_usage_events GROUP BY customer_id),
usage_decay AS (
  SELECT c.customer_id, coalesce(u.events_last_30d, 0) AS events_last_30d, coalesce(u.events_prev_30d, 0) AS events_prev_30d,
         CASE WHEN coalesce(u.events_prev_30d, 0) = 0 THEN 1.0
              ELSE greatest(0.0, 1.0 - CAST(coalesce(u.events_last_30d, 0) AS DOUBLE) / greatest(coalesce(u.events_prev_30d, 0), 1)) END AS usage_decay_score
  FROM raw_customers c LEFT JOIN ud_counts u USING (customer_id)),
composite AS (
  SELECT d.customer_id, d.usage_decay_score, coalesce(CAST(s.compliance_gap_score AS DOUBLE), 0.0) AS compliance_gap_score,
         coalesce(s.vendor_risk_flags, 0) AS vendor_risk_flags,
         CAST(round(CAST(0.50 * d.usage_decay_score + 0.35 * coalesce(CAST(s.compliance_gap_score AS DOUBLE), 0.0)
               + 0.15 * least(coalesce(s.vendor_risk_flags, 0) / 5.0, 1.0) AS DECIMAL(38,10)), 4) AS DOUBLE) AS risk_score
  FROM usage_decay d LEFT JOIN raw_risk_signals s USING (customer_id))"""

MISC = {
    "usage_decay": ("SELECT * FROM usage_decay", USAGE_DECAY_CTE),
    "risk_composite": (f"SELECT customer_id, usage_decay_score, compliance_gap_score, CAST(vendor_risk_flags AS BIGINT) AS vendor_risk_flags, "
                       f"risk_score, {tier('risk_score')} AS risk_tier FROM composite", USAGE_DECAY_CTE),
    "risk_simple_tier": ("""SELECT c.customer_id, c.industry, c.plan_tier, CAST(c.mrr AS DOUBLE) AS mrr, CAST(r.compliance_gap_score AS DOUBLE) AS compliance_gap_score,
       CAST(r.vendor_risk_flags AS BIGINT) AS vendor_risk_flags,
       CASE WHEN r.compliance_gap_score >= 0.7 OR r.vendor_risk_flags >= 3 THEN 'high'
            WHEN r.compliance_gap_score >= 0.4 OR r.vendor_risk_flags >= 1 THEN 'medium' ELSE 'low' END AS risk_tier
FROM stg_customers c LEFT JOIN stg_risk_signals r USING (customer_id) WHERE c.is_active""", ""),
    "churn_actions": (f"""SELECT customer_id, CAST(churn_score AS DOUBLE) AS churn_probability, {tier('churn_score')} AS risk_tier,
       churn_score >= 0.5 AS requires_action,
       CASE WHEN churn_score >= 0.75 THEN 'CRITICAL – Escalate to senior CSM immediately. Schedule EBR within 7 days.'
            WHEN churn_score >= 0.5 THEN 'HIGH RISK – Trigger CS outreach within 48 hours. Review top SHAP drivers.'
            WHEN churn_score >= 0.25 THEN 'MEDIUM RISK – Add to CSM watch list. Schedule check-in call.'
            ELSE 'LOW RISK – No immediate action required. Monitor monthly.' END AS action FROM mart_risk""", ""),
    "expansion_scoring": (f"""SELECT customer_id, plan_tier, upgrade_propensity_proxy AS propensity,
       {tier('upgrade_propensity_proxy')} AS propensity_tier, {next_tier('plan_tier')} AS target_tier,
       up AS expected_arr_uplift, {high_value('plan_tier', 'upgrade_propensity_proxy', 'up')} AS is_high_value_target,
       {action('plan_tier', 'upgrade_propensity_proxy', 'up')} AS recommended_action,
       {action('plan_tier', 'upgrade_propensity_proxy', 'up', 'churn_probability')} AS conflict_action,
       churn_probability >= 0.5 AND upgrade_propensity_proxy >= 0.5 AS is_flight_risk
FROM (SELECT *, {uplift('plan_tier', 'mrr', 'upgrade_propensity_proxy')} AS up FROM mart_quadrant)""", ""),
    "customer_360_table": (f"""SELECT b.customer_id, b.industry, b.plan_tier, CAST(b.mrr AS DOUBLE) AS mrr, CAST(b.tenure_days AS BIGINT) AS tenure_days,
       CAST(b.churn_score AS DOUBLE) AS churn_probability, {tier('b.churn_score')} AS churn_risk_tier,
       q.upgrade_propensity_proxy AS upgrade_propensity,
       CASE WHEN q.upgrade_propensity_proxy IS NOT NULL THEN {tier('q.upgrade_propensity_proxy')} END AS propensity_tier,
       {next_tier('b.plan_tier')} AS target_tier,
       CASE WHEN q.upgrade_propensity_proxy IS NOT NULL THEN {uplift('b.plan_tier', 'b.mrr', 'q.upgrade_propensity_proxy')} END AS expected_arr_uplift,
       CASE WHEN q.upgrade_propensity_proxy IS NOT NULL THEN {high_value('b.plan_tier', 'q.upgrade_propensity_proxy', uplift('b.plan_tier', 'b.mrr', 'q.upgrade_propensity_proxy'))} END AS is_high_value_target,
       CASE WHEN q.upgrade_propensity_proxy IS NOT NULL THEN {action('b.plan_tier', 'q.upgrade_propensity_proxy', uplift('b.plan_tier', 'b.mrr', 'q.upgrade_propensity_proxy'), 'b.churn_score')} END AS recommended_action,
       coalesce(b.churn_score >= 0.5 AND q.upgrade_propensity_proxy >= 0.5, FALSE) AS is_flight_risk,
       cm.risk_score AS composite_risk_score, {tier('cm.risk_score')} AS composite_risk_tier,
       coalesce(e.n, 0) AS events_last_30d, coalesce(t.n_open, 0) AS open_tickets,
       coalesce(o.stage, 'none') AS latest_opportunity_stage
FROM mart_risk b
LEFT JOIN mart_quadrant q USING (customer_id)
LEFT JOIN composite cm USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) AS n FROM raw_usage_events WHERE "timestamp" >= CAST({AS_OF} - 30 AS TIMESTAMP) GROUP BY 1) e USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) FILTER (WHERE resolution_time IS NULL) AS n_open FROM raw_support_tickets GROUP BY 1) t USING (customer_id)
LEFT JOIN (SELECT customer_id, stage FROM (SELECT customer_id, stage, row_number() OVER (PARTITION BY customer_id ORDER BY close_date DESC, opp_id DESC) AS rn FROM raw_gtm_opportunities) WHERE rn = 1) o USING (customer_id)""",
                           USAGE_DECAY_CTE),
    "lkp_active_by_mrr": ("SELECT * FROM raw_customers WHERE churn_date IS NULL", ""),
    "lkp_open_opps": ("SELECT * FROM raw_gtm_opportunities WHERE stage NOT IN ('closed_won', 'closed_lost')", ""),
    "lkp_events_since": (f"SELECT * FROM raw_usage_events WHERE \"timestamp\" >= {AS_OF_TS} - INTERVAL '14 days'", ""),
    "lkp_customer_by_id": ("SELECT * FROM raw_customers WHERE customer_id IN (SELECT customer_id FROM mart_risk WHERE risk_tier = 'critical')", ""),
    "lkp_event_count_n_days": (f"""SELECT c.customer_id, coalesce(n, 0) AS events_last_30d FROM raw_customers c LEFT JOIN
       (SELECT customer_id, count(*) AS n FROM raw_usage_events WHERE "timestamp" >= {AS_OF_TS} - INTERVAL '30 days' GROUP BY 1) e USING (customer_id)""", ""),
    "src_row_audit": ("""SELECT 'customers' AS table_name, count(*) AS row_count FROM raw_customers
UNION ALL SELECT 'usage_events', count(*) FROM raw_usage_events
UNION ALL SELECT 'support_tickets', count(*) FROM raw_support_tickets
UNION ALL SELECT 'gtm_opportunities', count(*) FROM raw_gtm_opportunities
UNION ALL SELECT 'risk_signals', count(*) FROM raw_risk_signals
UNION ALL SELECT 'expansion_outreach_log', count(*) FROM raw_expansion_outreach_log
UNION ALL SELECT 'mart_customer_churn_features', count(*) FROM mart_churn
UNION ALL SELECT 'mart_customer_risk_scores', count(*) FROM mart_risk
UNION ALL SELECT 'mart_customer_expansion_features', count(*) FROM mart_expansion
UNION ALL SELECT 'mart_propensity_quadrant', count(*) FROM mart_quadrant""", ""),
    "dq_freshness": (f"""SELECT CAST(date_diff('day', max(signup_date), {AS_OF}) AS BIGINT) AS age_days,
       CASE WHEN date_diff('day', max(signup_date), {AS_OF}) > 30 THEN 'error'
            WHEN date_diff('day', max(signup_date), {AS_OF}) > 7 THEN 'warn' ELSE 'pass' END AS status FROM raw_customers""", ""),
    # event-only operators on the driver's events table
    "events_usage_decay": (f"""SELECT u.customer_id, coalesce(a, 0) AS events_last_30d, coalesce(b, 0) AS events_prev_30d,
       CASE WHEN coalesce(b, 0) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - CAST(coalesce(a, 0) AS DOUBLE) / greatest(coalesce(b, 0), 1)) END AS usage_decay_score
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS customer_id FROM events) u LEFT JOIN
     (SELECT CAST(user_id AS VARCHAR) AS customer_id,
             count(*) FILTER (WHERE CAST(ts AS DATE) >= {EV_AS_OF} - 30) AS a,
             count(*) FILTER (WHERE CAST(ts AS DATE) >= {EV_AS_OF} - 60 AND CAST(ts AS DATE) < {EV_AS_OF} - 30) AS b
      FROM events GROUP BY 1) e USING (customer_id)""", ""),
    "events_count_n_days": (f"""SELECT CAST(user_id AS VARCHAR) AS customer_id,
       count(*) FILTER (WHERE ts >= {EV_AS_OF_TS} - INTERVAL '7 days') AS events_last_7d FROM events GROUP BY 1""", ""),
    "events_weekly_usage": (f"""SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week_start,
       count(*) AS event_count, CAST(round(CAST(avg(value) AS DECIMAL(38,10)), 3) AS DOUBLE) AS avg_value
FROM events WHERE ts >= CAST({EV_AS_OF} - INTERVAL '90 days' AS TIMESTAMP) GROUP BY 1, 2""", ""),
}
