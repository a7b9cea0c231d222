"""Output types of the SQL answers, aligned with the Spark outputs.

Inside the SQL, money and scores stay DECIMAL (exact thresholds) and float32
columns stay FLOAT (the original's comparisons); only the final projection
is cast to the boundary types every query uses: BIGINT, DOUBLE, VARCHAR,
DATE, TIMESTAMP, BOOLEAN.
"""

from __future__ import annotations

D, B = "DOUBLE", "BIGINT"

OUTPUT_CASTS: dict[str, dict[str, str]] = {
    "raw_customers": {"mrr": D},
    "raw_usage_events": {"feature_adoption_score": D},
    "raw_support_tickets": {"resolution_time": B},
    "raw_gtm_opportunities": {"amount": D},
    "raw_risk_signals": {"compliance_gap_score": D, "vendor_risk_flags": B},
    "raw_expansion_outreach_log": {"propensity_at_outreach": D},
    "stg_customers": {"mrr": D},
    "stg_usage_events": {"feature_adoption_score": D},
    "stg_support_tickets": {"resolution_time": B},
    "stg_gtm_opportunities": {"amount": D},
    "stg_risk_signals": {"compliance_gap_score": D, "vendor_risk_flags": B},
    "stg_expansion_outreach": {"propensity_at_outreach": D},
    "lkp_active_by_mrr": {"mrr": D},
    "lkp_customer_by_id": {"mrr": D},
    "lkp_events_since": {"feature_adoption_score": D},
    "lkp_open_opps": {"amount": D},
    "lkp_sample_n": {"mrr": D},
    "exp_eligibility": {"mrr": D},
    "mart_churn_features": {"mrr": D, "activated_at_30d": B},
    "feat_churn_from_raw": {"mrr": D, "activated_at_30d": B},
    "feat_expansion_from_raw": {"mrr": D, "expansion_opp_amount": D, "activated_at_30d": B},
    "mart_expansion_features": {"mrr": D, "expansion_opp_amount": D, "activated_at_30d": B},
    "mart_risk_scores": {"mrr": D, "arr": D, "churn_score": D, "arr_at_risk": D, "intervention_value_10pct": D,
                         "risk_flag_count": B},
    "quadrant_mart": {"churn_probability": D, "arr_at_risk": D, "mrr": D},
    "feat_eda_all": {"mrr": D, "is_churned": B},
    "eda_median_split": {"is_churned": B},
    "guard_confidence": {"confidence_score": D},
    "guard_unknown_feature": {"confidence_score": D},
    "guard_expansion_status": {"confidence_score": D},
    "ctx_brief_guardrails": {"confidence_score": D},
}


def wrap(name: str, sql: str) -> str:
    casts = OUTPUT_CASTS.get(name)
    if not casts:
        return sql
    rep = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in casts.items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS answer"
