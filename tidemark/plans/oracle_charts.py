"""Independent DuckDB SQL for the chart queries."""

from __future__ import annotations

from tidemark.plans.oracle_base import AS_OF


def P1(x: str) -> str:
    """round(avg(x) * 100, 1) on an exact decimal, as double."""
    return f"CAST(round(CAST(avg(CAST({x} AS DOUBLE)) * 100 AS DECIMAL(38,10)), 1) AS DOUBLE)"


def R0(x: str, d: int = 0) -> str:
    return f"CAST(round(sum({x}), {d}) AS DOUBLE)"


def RA(x: str, d: int) -> str:
    return f"CAST(round(CAST(avg(CAST({x} AS DOUBLE)) AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def CW(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


# What the charts show of a group of customers; each chart names its measures.
MEASURES = {
    "customers": "count(*)",
    "score_pct": P1("churn_score"),
    "at_risk": R0("arr_at_risk"),
    "avg_mrr": RA("mrr", 0),
    "critical": CW("risk_tier = 'critical'"),
    "high": CW("risk_tier = 'high'"),
    "worst_two": CW("list_contains(['critical', 'high'], risk_tier)"),
    "early": CW("is_early_stage"),
    "mrr": R0("mrr"),
    "arr": R0("arr"),
    "integrations": RA("integration_connects_first_30d", 1),
    **{f"back_{p}": R0(f"arr_at_risk * 0.{p}") for p in (10, 15, 20)},
}
WORST_TWO = "list_contains(['critical', 'high'], risk_tier)"
WORST_THREE = "risk_tier <> 'low'"
COST_PER_CUSTOMER = 600   # two contacts of 300 each


def summary(by: str, columns: dict[str, str], where: str = "TRUE") -> str:
    """One row a group of the scored customers: output column -> measure."""
    shown = ", ".join(f"{MEASURES[m]} AS {name}" for name, m in columns.items())
    return f"SELECT {by + ', ' if by else ''}{shown} FROM mart_risk WHERE {where}" + (" GROUP BY ALL" if by else "")


def banded(column: str, name: str, bands: list[tuple[int, str]], columns: dict[str, str]) -> str:
    """Groups by the last band whose lower bound the column reaches."""
    rows = ", ".join(f"({low}, '{label}')" for low, label in bands)
    return f"""SELECT (SELECT arg_max(label, low) FROM (VALUES {rows}) b(low, label) WHERE low <= {column}) AS {name},
       {", ".join(f"{MEASURES[m]} AS {c}" for c, m in columns.items())} FROM mart_risk GROUP BY 1"""


DRIVER_NAMES = {"flag_very_low_events": "Low Product Events (30d)", "flag_zero_recent_events": "Zero 7-Day Events", "flag_low_adoption": "Low Adoption Score",
                "flag_inactive_2w": "Inactive 14+ Days", "flag_high_support_load": "High-Priority Tickets", "flag_early_stage_at_risk": "Early-Stage at Risk",
                "flag_low_onboarding": "Low Onboarding"}
URGENCY = "list_position(['critical', 'high', 'medium', 'low'], priority)"
PENDING = "stage <> 'closed_won' AND stage <> 'closed_lost'"

CHARTS = {
    "heat_tier_industry": summary("plan_tier, industry", {"customer_count": "customers", "avg_churn_score_pct": "score_pct", "total_arr_at_risk": "at_risk",
                                                          "critical_count": "critical", "high_count": "high"}),
    "heat_tier_share": f"""SELECT g.*, CAST(round(CAST(100.0 * customer_count / (SELECT count(*) FROM mart_risk) AS DECIMAL(38,10)), 1) AS DOUBLE) AS pct_of_portfolio
FROM ({summary("risk_tier", {"customer_count": "customers", "arr_at_risk_usd": "at_risk"})}) g""",
    "heat_arr_by_plan": summary("plan_tier, risk_tier", {"arr_at_risk_usd": "at_risk", "customer_count": "customers"}),
    "heat_industry_rate": summary("industry", {"total_customers": "customers", "avg_churn_score_pct": "score_pct", "at_risk_count": "worst_two",
                                               "total_arr_at_risk_usd": "at_risk"}),
    "heat_kpi_row": summary("", {"total_active_customers": "customers", "at_risk_customers": "worst_two", "total_arr_at_risk": "at_risk",
                                 "portfolio_avg_churn_pct": "score_pct", "total_mrr": "mrr", "total_arr": "arr"}),
    "heat_score_histogram": banded("churn_score * 100", "score_bucket", [(0, "0–10%"), (10, "10–25%"), (25, "25–50%"), (50, "50–75%"), (75, "75–100%")],
                                   {"customer_count": "customers", "mrr_in_bucket": "mrr"}),
    "c360_header": """SELECT customer_id, CAST(round(100 * churn_score, 1) AS DOUBLE) AS churn_probability_pct, risk_tier, plan_tier, industry, top_risk_drivers,
       CAST(mrr AS DOUBLE) AS mrr, CAST(round(arr_at_risk, 0) AS DOUBLE) AS arr_at_risk_usd FROM mart_risk""",
    "c360_flag_unpivot": "SELECT customer_id, unnest([" + ", ".join(
        f"{{'driver': '{label}', 'active': CAST({flag} AS BIGINT)}}" for flag, label in DRIVER_NAMES.items()) + "], recursive := true) FROM mart_risk",
    "c360_weekly_usage": f"""SELECT customer_id, day - (isodow(day) - 1)::INTEGER AS week_start, count(*) AS event_count, {RA('adoption', 3)} AS avg_adoption
FROM facts WHERE is_event AND {AS_OF} - day <= 90 GROUP BY ALL""",
    "c360_ticket_table": f"""SELECT customer_id, row_number() OVER queue AS ticket_rank, ticket_id, created_date, priority, topic,
       {AS_OF} - created_date AS age_days, if(resolution_time IS NULL, 'Open', 'Resolved') AS status
FROM raw_support_tickets WINDOW queue AS (PARTITION BY customer_id ORDER BY {URGENCY}, {AS_OF} - created_date, ticket_id)
QUALIFY ticket_rank <= 20""",
    "c360_next_opp": f"""SELECT customer_id, o.opp_id, o.stage, CAST(round(o.amount, 0) AS DOUBLE) AS amount_usd, o.sales_owner, o.close_date,
       o.close_date - {AS_OF} AS days_to_close
FROM (SELECT customer_id, arg_min(x, (close_date, opp_id)) AS o FROM raw_gtm_opportunities x WHERE {PENDING} GROUP BY customer_id)""",
    "drill_at_risk_table": f"""SELECT customer_id, plan_tier, industry, CAST(round(mrr, 0) AS DOUBLE) AS mrr_usd, CAST(round(arr, 0) AS DOUBLE) AS arr_usd,
       CAST(round(100 * churn_score, 1) AS DOUBLE) AS churn_score_pct, risk_tier, CAST(round(arr_at_risk, 0) AS DOUBLE) AS arr_at_risk_usd,
       events_last_30d, avg_adoption_score, high_priority_tickets, days_since_last_event, top_risk_drivers, tenure_days,
       (MAP {{'critical': 'CRITICAL – Escalate to senior CSM. EBR within 7d.', 'high': 'HIGH RISK – Outreach within 48h. Review top drivers.'}})[risk_tier] AS recommended_action,
       coalesce(o.stage, 'none') AS gtm_stage, coalesce(CAST(round(o.amount, 0) AS DOUBLE), 0) AS gtm_amount_usd
FROM (FROM mart_risk WHERE {WORST_TWO} ORDER BY arr_at_risk DESC, customer_id LIMIT 200)
LEFT JOIN (SELECT customer_id, arg_max(x, (close_date, opp_id)) AS o FROM raw_gtm_opportunities x WHERE {PENDING} GROUP BY customer_id) USING (customer_id)""",
    "drill_scatter": """SELECT customer_id, CAST(churn_score AS DOUBLE) AS churn_score, CAST(mrr AS DOUBLE) AS mrr, plan_tier, risk_tier, events_last_30d, avg_adoption_score
FROM (FROM mart_risk ORDER BY churn_score DESC, customer_id LIMIT 500)""",
    "drill_usage_funnel": banded("if(events_last_7d > 0, 10 + events_last_7d, least(events_last_30d, 1))", "engagement_stage",
                                 [(0, "4. Dormant (0 events in 30d)"), (1, "3. Declining (0/7d, activity/30d)"), (11, "2. Engaged (1-4 events/7d)"),
                                  (15, "1. Active (5+ events/7d)")], {"customer_count": "customers", "avg_churn_pct": "score_pct", "arr_at_risk_usd": "at_risk"}),
    "drill_ticket_load": banded("high_priority_tickets", "ticket_bucket", [(0, "0 HP tickets"), (1, "1 HP ticket"), (2, "2 HP tickets"), (3, "3+ HP tickets")],
                                {"customer_count": "customers", "avg_churn_score_pct": "score_pct", "avg_mrr": "avg_mrr"}),
    "drill_onboarding_tier": banded("integration_connects_first_30d", "onboarding_tier",
                                    [(0, "0 integrations"), (1, "1-2 integrations"), (3, "3-5 integrations"), (6, "6+ integrations")],
                                    {"customer_count": "customers", "avg_churn_pct": "score_pct", "early_stage_count": "early"}),
    "uplift_cumulative": f"""SELECT place AS accounts_targeted, customer_id, risk_tier, plan_tier, CAST(mrr AS DOUBLE) AS mrr, CAST(churn_score AS DOUBLE) AS churn_score,
       CAST(round(arr_at_risk, 0) AS DOUBLE) AS arr_at_risk_individual, CAST(round(so_far, 0) AS DOUBLE) AS cumulative_arr_at_risk,
       CAST(round(so_far * 0.10, 0) AS DOUBLE) AS recoverable_arr_10pct, CAST(round(so_far * 0.15, 0) AS DOUBLE) AS recoverable_arr_15pct,
       CAST(round(so_far * 0.20, 0) AS DOUBLE) AS recoverable_arr_20pct
FROM (SELECT *, row_number() OVER o AS place, sum(arr_at_risk) OVER o AS so_far FROM mart_risk WHERE {WORST_THREE}
      WINDOW o AS (ORDER BY arr_at_risk DESC, customer_id ROWS UNBOUNDED PRECEDING) QUALIFY place <= 500)""",
    "uplift_top_n_roi": " UNION ALL ".join(
        f"""(SELECT CAST({n} AS BIGINT) AS top_n_customers, {", ".join(f"{MEASURES[m]} AS {c}" for c, m in (
            ("total_arr_at_risk", "at_risk"), ("recoverable_10pct", "back_10"), ("recoverable_15pct", "back_15"), ("recoverable_20pct", "back_20"),
            ("actual_customer_count", "customers"), ("avg_churn_score_pct", "score_pct")))}, CAST({n * COST_PER_CUSTOMER} AS BIGINT) AS intervention_cost_usd,
       CAST(round(CAST(100 * (sum(arr_at_risk * 0.10) / {n * COST_PER_CUSTOMER} - 1) AS DECIMAL(38,10)), 1) AS DOUBLE) AS roi_10pct
FROM (FROM mart_risk WHERE {WORST_TWO} ORDER BY arr_at_risk DESC, customer_id LIMIT {n}) HAVING count(*) > 0)""" for n in (10, 25, 50, 100)),
    "uplift_segments": f"""SELECT * FROM ({summary("plan_tier, industry", {"at_risk_customers": "customers", "total_arr_at_risk": "at_risk",
        "recoverable_arr_15pct": "back_15", "avg_churn_pct": "score_pct", "avg_mrr": "avg_mrr"}, WORST_TWO)})
JOIN (SELECT plan_tier, industry FROM mart_risk WHERE {WORST_TWO} GROUP BY ALL ORDER BY sum(arr_at_risk) DESC, plan_tier, industry LIMIT 15) USING (plan_tier, industry)""",
    "uplift_kpi": f"""SELECT g.*, (SELECT CAST(round(CAST(sum(arr_at_risk * 0.15) / {50 * COST_PER_CUSTOMER} AS DECIMAL(38,10)), 1) AS DOUBLE) FROM mart_risk WHERE {WORST_TWO}) AS payback_ratio_top50
FROM ({summary("", {"at_risk_customers": "customers", "total_arr_at_risk": "at_risk", **{f"recoverable_arr_{p}pct": f"back_{p}" for p in (10, 15, 20)}}, WORST_TWO)}) g""",
    "uplift_early_stage": summary("is_early_stage", {"customer_count": "customers", "avg_churn_pct": "score_pct", "total_arr_at_risk": "at_risk",
                                                     "recoverable_15pct": "back_15", "avg_onboarding_integrations": "integrations"}, WORST_THREE),
}
