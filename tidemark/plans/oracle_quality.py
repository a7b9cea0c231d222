"""Independent DuckDB SQL for the data-contract queries."""

from __future__ import annotations

from tidemark.operators.quality import CHILD_TABLES, RANGE_CHECKS, RAW_CONTRACTS


def _row(check: str, table: str, col: str, bad_pred: str) -> str:
    return (f"SELECT '{check}' AS \"check\", '{table}' AS table_name, '{col}' AS column_name, "
            f"CAST(count(*) FILTER (WHERE {bad_pred}) AS BIGINT) AS n_bad, "
            f"count(*) FILTER (WHERE {bad_pred}) = 0 AS passed FROM raw_{table}")


def contract_report_sql() -> str:
    parts = []
    for t, spec in RAW_CONTRACTS.items():
        for c in spec["not_null"]:
            parts.append(_row("not_null", t, c, f'"{c}" IS NULL'))
        for c, vals in spec["accepted"].items():
            lst = ", ".join(f"'{v}'" for v in vals)
            parts.append(_row("accepted_values", t, c, f'"{c}" IS NOT NULL AND "{c}" NOT IN ({lst})'))
        for tt, c, lo, hi in RANGE_CHECKS:
            if tt == t:
                conds = []
                if lo is not None:
                    conds.append(f"{c} < {lo}")
                if hi is not None:
                    conds.append(f"{c} > {hi}")
                parts.append(_row("range", t, c, " OR ".join(conds)))
        if t == "support_tickets":
            parts.append(_row("range", t, "resolution_time", "resolution_time <= 0"))
        if t == "customers":
            parts.append(_row("conditional_mrr_non_negative", t, "mrr", "mrr < 0"))
            parts.append(_row("conditional_paid_mrr_positive", t, "mrr", "plan_tier <> 'free' AND mrr <= 0"))
            parts.append(_row("conditional_free_mrr_zero", t, "mrr", "plan_tier = 'free' AND mrr <> 0"))
            parts.append(_row("temporal_churn_after_signup", t, "churn_date",
                              "churn_date IS NOT NULL AND churn_date <= signup_date"))
        k = spec["unique"]
        parts.append(f"SELECT 'unique', '{t}', '{k}', CAST(count({k}) - count(DISTINCT {k}) AS BIGINT), "
                     f"count({k}) = count(DISTINCT {k}) FROM raw_{t}")
    for t in CHILD_TABLES:
        parts.append(f"SELECT 'foreign_key', '{t}', 'customer_id', CAST(count(*) AS BIGINT), count(*) = 0 "
                     f"FROM raw_{t} x WHERE NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = x.customer_id)")
    parts.append("SELECT 'temporal_event_after_signup', 'usage_events', 'timestamp', CAST(count(*) AS BIGINT), count(*) = 0 "
                 "FROM raw_usage_events e JOIN raw_customers c USING (customer_id) WHERE e.\"timestamp\" < CAST(c.signup_date AS TIMESTAMP)")
    parts.append("SELECT 'temporal_event_before_churn', 'usage_events', 'timestamp', CAST(count(*) AS BIGINT), count(*) = 0 "
                 "FROM raw_usage_events e JOIN raw_customers c USING (customer_id) WHERE c.churn_date IS NOT NULL "
                 "AND e.\"timestamp\" > CAST(c.churn_date AS TIMESTAMP)")
    parts.append("SELECT 'spread_signup_days', 'customers', 'signup_date', "
                 "CAST(greatest(0, 548 - date_diff('day', min(signup_date), max(signup_date))) AS BIGINT), "
                 "date_diff('day', min(signup_date), max(signup_date)) >= 548 FROM raw_customers")
    parts.append("SELECT 'row_count_one_per_customer', 'risk_signals', 'customer_id', "
                 "CAST(abs((SELECT count(*) FROM raw_customers) - (SELECT count(*) FROM raw_risk_signals)) AS BIGINT), "
                 "(SELECT count(*) FROM raw_customers) = (SELECT count(*) FROM raw_risk_signals)")
    return "\nUNION ALL\n".join(parts)


ROW_COUNT_SQL = """
SELECT table_name, rule, expected, n_rows, CASE rule WHEN 'exact' THEN n_rows = expected ELSE n_rows >= expected END AS passed FROM (
  SELECT 'risk_signals' AS table_name, 'exact' AS rule, (SELECT count(*) FROM raw_customers) AS expected, (SELECT count(*) FROM raw_risk_signals) AS n_rows
  UNION ALL SELECT 'customers', 'minimum', 1, (SELECT count(*) FROM raw_customers)
  UNION ALL SELECT 'usage_events', 'minimum', (SELECT count(*) FROM raw_customers), (SELECT count(*) FROM raw_usage_events)
  UNION ALL SELECT 'support_tickets', 'minimum', 1, (SELECT count(*) FROM raw_support_tickets)
  UNION ALL SELECT 'gtm_opportunities', 'minimum', 1, (SELECT count(*) FROM raw_gtm_opportunities)
  UNION ALL SELECT 'expansion_outreach_log', 'minimum', 1, (SELECT count(*) FROM raw_expansion_outreach_log))"""

RATE_BANDS_SQL = """
SELECT metric, CAST(round(CAST(value AS DECIMAL(38,10)), 6) AS DOUBLE) AS value, low, high,
       value BETWEEN low AND high AS passed
FROM (
  SELECT 'churn_starter' AS metric, avg(CASE WHEN plan_tier = 'starter' THEN CAST(churn_date IS NOT NULL AS INTEGER) END) AS value, 0.35::DOUBLE AS low, 0.55::DOUBLE AS high FROM raw_customers
  UNION ALL SELECT 'churn_growth', avg(CASE WHEN plan_tier = 'growth' THEN CAST(churn_date IS NOT NULL AS INTEGER) END), 0.12, 0.28 FROM raw_customers
  UNION ALL SELECT 'churn_enterprise', avg(CASE WHEN plan_tier = 'enterprise' THEN CAST(churn_date IS NOT NULL AS INTEGER) END), 0.04, 0.15 FROM raw_customers
  UNION ALL SELECT 'upgrade_rate', avg(CAST(upgrade_date IS NOT NULL AS INTEGER)), 0.05, 0.25 FROM raw_customers
  UNION ALL SELECT 'high_propensity_share', avg(CAST(propensity_at_outreach > 0.65 AS INTEGER)), 0.50, 1.0 FROM raw_expansion_outreach_log
  UNION ALL SELECT 'outreach_conversion', avg(CAST(outcome = 'upgraded' AS INTEGER)), 0.15, 0.40 FROM raw_expansion_outreach_log
)"""
