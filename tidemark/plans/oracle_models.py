"""Independent DuckDB SQL for the metric operators on the rule score."""

from __future__ import annotations

from tidemark.functions import constants as K
from tidemark.plans.oracle_analysis import ANALYSIS, ANALYSIS_CTES
from tidemark.plans.oracle_misc import MISC


def r9(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), 9) AS DOUBLE)"


_FLAGS = """
(CAST(events_last_30d < 5 AS INTEGER) * 0.18 + CAST(events_last_7d = 0 AS INTEGER) * 0.20
 + CAST(avg_adoption_score < 0.25 AS INTEGER) * 0.15 + CAST(days_since_last_event > 14 AS INTEGER) * 0.12
 + CAST(high_priority_tickets >= 2 AS INTEGER) * 0.12 + CAST(tickets_last_30d >= 5 AS INTEGER) * 0.08
 + CAST(is_early_stage = 1 AND events_last_30d < 3 AS INTEGER) * 0.15
 + CAST(integration_connects_first_30d < 3 AND tenure_days <= 90 AS INTEGER) * 0.10
 + CAST(retention_signal_count = 0 AS INTEGER) * 0.10)"""

_PLANS = ", ".join(f"'{p}'" for p in K.PLAN_TIERS)

MODEL_CTES = ANALYSIS_CTES + f""",
cpit AS ({ANALYSIS['train_churn_pit']}),
reval AS (SELECT customer_id, CAST(round(least(1.0, greatest(0.0, 0.10 + {_FLAGS})), 4) AS DOUBLE) AS score,
                 label, CAST(mrr AS DOUBLE) AS mrr, plan_tier FROM cpit),
rranks AS (SELECT score, count(*) AS cnt, sum(label) AS pos FROM reval GROUP BY score),
rpos AS (SELECT *, row_number() OVER (ORDER BY score DESC, customer_id) - 1 AS pos, count(*) OVER () AS n FROM reval),
xs AS ({MISC['expansion_scoring'][0]})"""

MODELS = {
    "ml_auc_churn_rule": f"""
SELECT {r9('(sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(cnt) - sum(pos)))')} AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(cnt) - sum(pos) AS BIGINT) AS n_neg
FROM (SELECT *, sum(cnt) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before0,
             coalesce(sum(cnt) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cnt + 1) / 2.0 AS rk
      FROM rranks)""",
    "ml_brier_churn_rule": f"SELECT {r9('avg((score - label) * (score - label))')} AS brier FROM reval",
    "ml_precision_top_decile_rule": f"""
SELECT {r9('(SELECT avg(label) FROM rpos WHERE pos < greatest(1, n // 10))')} AS precision_top_n,
       {r9('(SELECT avg(label) FROM reval WHERE score >= (SELECT quantile_cont(score, 0.9) FROM reval))')} AS precision_above_p90,
       CAST((SELECT greatest(1, count(*) // 10) FROM reval) AS BIGINT) AS top_n""",
    "ml_calibration_curve_rule": f"""
SELECT CAST(greatest(0, ceil(score * 10) - 1) AS BIGINT) AS bin, count(*) AS n, {r9('avg(score)')} AS mean_predicted,
       {r9('avg(label)')} AS fraction_positive FROM reval GROUP BY 1""",
    "ml_decile_table_rule": f"""
SELECT CAST(greatest(1, ceil(10 * pos / greatest(n - 1, 1))) AS BIGINT) AS decile, count(*) AS n_customers,
       CAST(sum(label) AS BIGINT) AS n_churned, {r9('avg(label)')} AS precision, {r9('avg(mrr)')} AS avg_mrr,
       {r9('sum(mrr) * 12')} AS total_arr FROM rpos GROUP BY 1""",
    "ml_decile_lift_rule": f"""
WITH e AS (SELECT quantile_cont(propensity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM xs)
SELECT CAST(1 + len(list_filter((SELECT q FROM e), lambda x: propensity > x)) AS BIGINT) AS decile, count(*) AS n,
       {r9('avg(propensity)')} AS mean_propensity, {r9('sum(expected_arr_uplift)')} AS total_arr_uplift,
       {r9('sum(expected_arr_uplift) * 0.25')} AS captured_arr
FROM xs GROUP BY 1""",
    "ml_class_weight": f"""
SELECT CAST(label AS DOUBLE) AS label, count(*) AS n,
       {r9("CASE WHEN label = 1 THEN (SELECT CAST(count(*) - sum(label) AS DOUBLE) / sum(label) FROM cpit) ELSE 1.0 END")} AS weight
FROM cpit GROUP BY label""",
    "ml_ordinal_encode": f"""
SELECT customer_id,
       coalesce(CAST(list_position([{_PLANS}], lower(plan_tier)) - 1 AS DOUBLE), -1.0) AS plan_tier_code,
       coalesce(CAST(list_position([{", ".join(f"'{i.lower()}'" for i in K.INDUSTRIES)}], lower(industry)) - 1 AS DOUBLE), -1.0) AS industry_code
FROM raw_customers""",
    "ml_standardise": "SELECT customer_id, " + ", ".join(
        f"{r9(f'(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1)')} AS {c}"
        for c in K.CHURN_NUMERIC_FEATURES) + " FROM cpit",
    "feat_to_model_row": "SELECT customer_id, " + ", ".join(
        f"CAST(CAST({c} AS INTEGER) AS DOUBLE) AS {c}" if c == "is_early_stage" else f"CAST({c} AS DOUBLE) AS {c}"
        for c in K.CHURN_NUMERIC_FEATURES) + ", lower(plan_tier) AS plan_tier, lower(industry) AS industry FROM mart_churn",
    "train_time_split": f"""SELECT CASE WHEN signup_date < DATE '{K.ORDERS_TRAIN_CUTOFF.isoformat()}' THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, {r9('avg(CAST(label AS DOUBLE))')} AS churn_rate FROM cpit GROUP BY 1""",
    "feat_validation_mart_join": """SELECT e.customer_id, e.plan_tier, e.premium_feature_trials_30d,
       CAST(CASE WHEN c.upgrade_date IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS label
FROM mart_expansion e JOIN raw_customers c USING (customer_id)""",
}

VALUE_GUARD = """
SELECT customer_id, 'churn_probability_out_of_range' AS reject_reason FROM mart_risk WHERE NOT churn_score BETWEEN 0 AND 1
UNION ALL SELECT customer_id, 'propensity_out_of_range' FROM mart_quadrant WHERE NOT upgrade_propensity_proxy BETWEEN 0 AND 1
UNION ALL SELECT customer_id, reason FROM (
  SELECT r.customer_id, CASE WHEN c.c_acctbal < 0 THEN 'mrr_negative' WHEN r.churn_date < r.signup_date THEN 'churn_before_signup'
                             WHEN u.low < 0 OR u.high > 1 THEN 'adoption_out_of_range' END AS reason
  FROM raw_customers r JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = r.customer_id
  LEFT JOIN (SELECT customer_id, min(feature_adoption_score) AS low, max(feature_adoption_score) AS high FROM raw_usage_events GROUP BY 1) u
    ON u.customer_id = r.customer_id) WHERE reason IS NOT NULL"""
