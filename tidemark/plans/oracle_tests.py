"""Independent DuckDB SQL for two-sample statistics and experiment tables."""

from __future__ import annotations

from tidemark.plans.oracle_base import AS_OF

ASSIGN = f"({AS_OF} - 90)"


def r9(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), 9) AS DOUBLE)"


def mwu_sql(src: str, name: str, alternative: str) -> str:
    u = "u1" if alternative == "greater" else "n1 * n2 - u1"
    return f"""
SELECT '{name}' AS test, '{alternative}' AS alternative, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
       {r9('u1')} AS u_statistic,
       {r9(f'(({u}) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))))')} AS z
FROM (SELECT CAST(sum(g) AS DOUBLE) AS n1, CAST(count(*) - sum(g) AS DOUBLE) AS n2,
             sum(CASE WHEN g = 1 THEN rk END) - sum(g) * (sum(g) + 1) / 2.0 AS u1,
             (SELECT sum(c * c * c - c) FROM (SELECT count(*) AS c FROM {src} GROUP BY v)) AS tie
      FROM (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM {src}))"""


def t_sql(src: str, name: str) -> str:
    return f"""
SELECT '{name}' AS test, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r9('m1')} AS mean1, {r9('m2')} AS mean2,
       {r9('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))')} AS t_stat,
       CAST(n1 + n2 - 2 AS BIGINT) AS df
FROM (SELECT CAST(count(*) FILTER (WHERE g = 1) AS DOUBLE) AS n1, avg(v) FILTER (WHERE g = 1) AS m1,
             var_samp(v) FILTER (WHERE g = 1) AS v1, CAST(count(*) FILTER (WHERE g = 0) AS DOUBLE) AS n2,
             avg(v) FILTER (WHERE g = 0) AS m2, var_samp(v) FILTER (WHERE g = 0) AS v2 FROM {src})"""


TEST_CTES = f"""
mw_events AS (
  SELECT CASE WHEN c.churn_date IS NOT NULL THEN 1 ELSE 0 END AS g, CAST(coalesce(e.n, 0) AS DOUBLE) AS v
  FROM raw_customers c LEFT JOIN (
    SELECT customer_id, count(*) AS n FROM raw_usage_events
    WHERE "timestamp" >= (SELECT max("timestamp") FROM raw_usage_events) - INTERVAL '30 days' GROUP BY 1) e USING (customer_id)),
mw_trials AS (
  SELECT CASE WHEN c.upgrade_date IS NOT NULL THEN 1 ELSE 0 END AS g, CAST(count(e.event_id) AS DOUBLE) AS v
  FROM raw_customers c LEFT JOIN raw_usage_events e ON c.customer_id = e.customer_id
    AND e.event_type = 'premium_feature_trial' AND CAST(e."timestamp" AS DATE) >= {AS_OF} - 30
  WHERE c.churn_date IS NULL GROUP BY c.customer_id, g),
mw_limits AS (
  SELECT CASE WHEN c.upgrade_date IS NOT NULL THEN 1 ELSE 0 END AS g, CAST(count(e.event_id) AS DOUBLE) AS v
  FROM raw_customers c LEFT JOIN raw_usage_events e ON c.customer_id = e.customer_id AND e.event_type = 'feature_limit_hit'
  WHERE c.plan_tier = 'free' GROUP BY c.customer_id, g),
t_integr AS (
  SELECT CASE WHEN c.churn_date IS NULL THEN 1 ELSE 0 END AS g, CAST(coalesce(e.n, 0) AS DOUBLE) AS v
  FROM raw_customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM raw_usage_events
                                  WHERE event_type = 'integration_connect' GROUP BY 1) e USING (customer_id)),
t_tickets AS (
  SELECT CASE WHEN c.churn_date IS NOT NULL THEN 1 ELSE 0 END AS g, CAST(coalesce(t.n, 0) AS DOUBLE) AS v
  FROM raw_customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM raw_support_tickets
                                  WHERE priority IN ('high', 'critical') GROUP BY 1) t USING (customer_id)),
t_gap AS (
  SELECT CASE WHEN c.churn_date IS NOT NULL THEN 1 ELSE 0 END AS g, CAST(r.compliance_gap_score AS DOUBLE) AS v
  FROM raw_customers c LEFT JOIN raw_risk_signals r USING (customer_id) WHERE r.compliance_gap_score IS NOT NULL)"""

TESTS = {
    "test_mann_whitney_stats": " UNION ALL ".join([
        mwu_sql("mw_events", "events_30d_churned_lt_active", "less"),
        mwu_sql("mw_trials", "premium_trials_upgraded_gt_not", "greater"),
        mwu_sql("mw_limits", "free_limit_hits_expanded_gt_not", "greater")]),
    "test_t_stats": " UNION ALL ".join([
        t_sql("t_integr", "integrations_retained_gt_churned"),
        t_sql("t_tickets", "hp_tickets_churned_gt_active"),
        t_sql("t_gap", "compliance_gap_churned_gt_active")]),
    "test_mean_ratio": f"""SELECT 'events_30d_churned_vs_active' AS test, {r9('m1')} AS mean1, {r9('m2')} AS mean2, m1 < 0.6 * m2 AS passed
FROM (SELECT avg(v) FILTER (WHERE g = 1) AS m1, avg(v) FILTER (WHERE g = 0) AS m2 FROM mw_events)""",
    "exp_eligibility": f"""SELECT c.* FROM raw_customers c
WHERE c.signup_date <= {ASSIGN} AND (c.churn_date IS NULL OR c.churn_date > {ASSIGN})
  AND date_diff('day', c.signup_date, {ASSIGN}) BETWEEN 14 AND 90
  AND NOT EXISTS (SELECT 1 FROM raw_support_tickets t WHERE t.customer_id = c.customer_id
                  AND t.priority IN ('high', 'critical') AND t.resolution_time IS NULL AND t.created_date <= {ASSIGN})""",
    "exp_required_n": f"""SELECT plan_tier, n_customers, CAST(round(CAST(rate AS DECIMAL(38,12)), 6) AS DOUBLE) AS baseline_churn_90d,
       CASE WHEN rate > 0.10 THEN CAST(ceil(pow(1.6448536269514722 * sqrt(2 * ((rate + rate - 0.10) / 2) * (1 - (rate + rate - 0.10) / 2))
            + 0.8416212335729143 * sqrt(rate * (1 - rate) + (rate - 0.10) * (1 - (rate - 0.10))), 2) / pow(0.10, 2)) AS BIGINT) END AS required_n_per_arm
FROM (SELECT plan_tier, count(*) AS n_customers,
             avg(CASE WHEN churn_date IS NOT NULL AND date_diff('day', signup_date, coalesce(churn_date, {AS_OF})) <= 90 THEN 1 ELSE 0 END) AS rate
      FROM raw_customers GROUP BY 1)""",
    "outreach_lift": """SELECT outreach_channel,
       CASE WHEN propensity_at_outreach >= CAST(0.65 AS FLOAT) THEN 'high' WHEN propensity_at_outreach >= CAST(0.35 AS FLOAT) THEN 'medium' ELSE 'low' END AS propensity_band,
       count(*) AS n, count(*) FILTER (WHERE outcome = 'upgraded') AS converted,
       CAST(round(CAST(count(*) FILTER (WHERE outcome = 'upgraded') / count(*) AS DECIMAL(38,12)), 6) AS DOUBLE) AS conversion_rate
FROM raw_expansion_outreach_log GROUP BY 1, 2""",
}

_ELIGIBLE = TESTS["exp_eligibility"]
_ARMS = f"""arms AS (
  SELECT customer_id, plan_tier, signup_date, churn_date,
         CASE WHEN (row_number() OVER (PARTITION BY plan_tier ORDER BY md5('exp-1-42-' || customer_id), customer_id)) % 2 = 1
              THEN 'treatment' ELSE 'control' END AS arm
  FROM ({_ELIGIBLE}))"""
_OUTCOME = f"""outcome AS (
  SELECT arm, count(*) AS n, count(*) FILTER (WHERE churn_date > {ASSIGN} AND churn_date <= {ASSIGN} + 90) AS churned
  FROM arms GROUP BY arm)"""
# P(control rate > treatment rate) for independent Beta posteriors with whole-number parameters, as a finite sum
_POSTERIOR = f"""{_ARMS}, {_OUTCOME},
both_arms AS (SELECT coalesce(max(n) FILTER (WHERE arm = 'treatment'), 0) AS nt, coalesce(max(churned) FILTER (WHERE arm = 'treatment'), 0) AS ct,
                     coalesce(max(n) FILTER (WHERE arm = 'control'), 0) AS nc, coalesce(max(churned) FILTER (WHERE arm = 'control'), 0) AS cc FROM outcome),
pars AS (SELECT prior, a, b, nt, ct, nc, cc, CAST(a + ct AS DOUBLE) AS ta, CAST(b + nt - ct AS DOUBLE) AS tb,
                CAST(a + cc AS DOUBLE) AS ca, CAST(b + nc - cc AS DOUBLE) AS cb
         FROM both_arms, (VALUES ('weak', 1, 4), ('base', 2, 8), ('moderate', 3, 7), ('informative', 5, 15)) p(prior, a, b)),
win AS (SELECT prior, sum(exp(lgamma(ta + i) + lgamma(tb + cb) - lgamma(ta + i + tb + cb) - ln(cb + i)
                              - lgamma(1 + i) - lgamma(cb) + lgamma(1 + i + cb) - lgamma(ta) - lgamma(tb) + lgamma(ta + tb))) AS p
        FROM (SELECT *, unnest(range(0, CAST(ca AS BIGINT))) AS i FROM pars) GROUP BY prior),
post AS (SELECT prior, CAST(a AS BIGINT) AS prior_a, CAST(b AS BIGINT) AS prior_b, nt AS n_treatment, ct AS churn_treatment, nc AS n_control, cc AS churn_control,
                round(least(1.0, greatest(0.0, p)), 9) AS p_treatment_better, round(1 - least(1.0, greatest(0.0, p)), 9) AS p_harm,
                round(ca / (ca + cb) - ta / (ta + tb), 6) AS effect_mean,
                round(sqrt(ca * cb / (pow(ca + cb, 2) * (ca + cb + 1)) + ta * tb / (pow(ta + tb, 2) * (ta + tb + 1))), 6) AS effect_sd
         FROM pars JOIN win USING (prior))"""
TESTS |= {
    "exp_assign": f"WITH {_ARMS} SELECT * FROM arms",
    "exp_outcomes": f"WITH {_ARMS}, {_OUTCOME} SELECT arm, n, churned AS churned_90d FROM outcome",
    "exp_secondary": f"""WITH {_ARMS},
used AS (SELECT customer_id, count(*) FILTER (WHERE event_type = 'integration_connect' AND CAST("timestamp" AS DATE) < {ASSIGN} + 30) AS i,
                avg(feature_adoption_score) AS adoption
         FROM raw_usage_events WHERE CAST("timestamp" AS DATE) >= {ASSIGN} AND CAST("timestamp" AS DATE) < {ASSIGN} + 60 GROUP BY 1),
asked AS (SELECT customer_id, count(*) AS n FROM raw_support_tickets WHERE created_date >= {ASSIGN} AND created_date < {ASSIGN} + 30 GROUP BY 1)
SELECT arm, {r9('avg(CASE WHEN i > 0 THEN 1 ELSE 0 END)')} AS integration_rate_30d, {r9('avg(adoption)')} AS adoption_60d,
       {r9('avg(coalesce(asked.n, 0))')} AS tickets_per_customer_30d
FROM arms LEFT JOIN used USING (customer_id) LEFT JOIN asked USING (customer_id) GROUP BY arm""",
    "exp_posterior": f"WITH {_POSTERIOR} SELECT * FROM post WHERE prior = 'base'",
    "exp_prior_sensitivity": f"WITH {_POSTERIOR} SELECT * FROM post",
    "exp_decision": f"""WITH {_POSTERIOR} SELECT prior, p_treatment_better, p_harm,
       CASE WHEN p_harm > 0.10 THEN 'stop' WHEN p_treatment_better >= 0.90 THEN 'effective' WHEN p_treatment_better >= 0.70 THEN 'extend'
            ELSE 'redesign' END AS decision,
       p_treatment_better > 0.95 AND least(n_treatment, n_control) >= 40 AS early_stop_success FROM post""",
}
