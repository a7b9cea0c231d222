"""The adapter, staging views and marts as DuckDB SQL (independent oracle).

Every oracle query is ``WITH <these CTEs> SELECT ...`` over the driver's
pre-registered views, so it shares no code with the Spark jobs it checks.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"
AS_OF_TS = "TIMESTAMP '2001-08-01 00:00:00'"


def z(d: str) -> str:
    return f"({AS_OF} - CAST(floor(date_diff('day', CAST({d} AS DATE), {AS_OF}) / 8) AS INTEGER))"


RAW = f"""
raw_spans AS (
  SELECT o_custkey,
         min(CAST(o_orderdate AS DATE)) AS first_d,
         max(CAST(o_orderdate AS DATE)) AS last_d,
         min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_totalprice > 200000) AS big_d
  FROM orders
  WHERE o_orderdate < {AS_OF_TS}
    AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01' + CAST((o_custkey * 37) % 2400 AS INTEGER)
  GROUP BY o_custkey
),
raw_spans2 AS (
  SELECT o_custkey, {z('first_d')} AS signup_date, {z('last_d')} AS last_z,
         CASE WHEN big_d IS NULL THEN NULL ELSE {z('big_d')} END AS up_z
  FROM raw_spans
),
raw_spans3 AS (
  SELECT *, CASE WHEN last_z < {AS_OF} - 45 AND last_z > signup_date THEN last_z END AS churn_date
  FROM raw_spans2
),
raw_customers AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id,
         c.c_mktsegment AS industry,
         CASE WHEN CAST(greatest(c.c_acctbal, 0) AS DECIMAL(10,2)) <= 0 THEN 'free'
              WHEN CAST(greatest(c.c_acctbal, 0) AS DECIMAL(10,2)) < 2000 THEN 'starter'
              WHEN CAST(greatest(c.c_acctbal, 0) AS DECIMAL(10,2)) < 8000 THEN 'growth'
              ELSE 'enterprise' END AS plan_tier,
         s.signup_date,
         CAST(greatest(c.c_acctbal, 0) AS DECIMAL(10,2)) AS mrr,
         s.churn_date,
         CASE WHEN s.churn_date IS NULL AND s.up_z >= s.signup_date + 30 THEN s.up_z END AS upgrade_date
  FROM raw_spans3 s JOIN customer c ON c.c_custkey = s.o_custkey
),
raw_li AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_shipdate,
         CAST(o.o_custkey AS VARCHAR) AS cid, {z('l.l_shipdate')} AS zd
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_shipdate < {AS_OF_TS}
),
raw_usage_events AS (
  SELECT concat_ws('-', CAST(e.l_orderkey AS VARCHAR), CAST(e.l_linenumber AS VARCHAR),
                   CAST(e.l_partkey AS VARCHAR), CAST(e.l_suppkey AS VARCHAR),
                   strftime(e.l_shipdate, '%Y%m%d')) AS event_id,
         c.customer_id,
         CAST(e.zd AS TIMESTAMP) AS "timestamp",
         (['evidence_upload', 'monitoring_run', 'report_view', 'user_invite', 'integration_connect',
           'api_call', 'premium_feature_trial', 'feature_limit_hit'])[CAST((e.l_orderkey + e.l_linenumber + e.l_partkey) % 8 AS INTEGER) + 1] AS event_type,
         CAST(e.l_quantity / 50 AS FLOAT) AS feature_adoption_score
  FROM raw_li e
  JOIN raw_customers c ON c.customer_id = e.cid
  WHERE e.zd >= c.signup_date AND (c.churn_date IS NULL OR e.zd <= c.churn_date)
),
raw_support_tickets AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS ticket_id,
         c.customer_id,
         {z('o.o_orderdate')} AS created_date,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
         CAST(CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE 1 + o.o_orderkey % 72 END AS INTEGER) AS resolution_time,
         (['compliance', 'integration', 'billing', 'onboarding', 'feature_request'])[CAST(o.o_orderkey % 5 AS INTEGER) + 1] AS topic
  FROM orders o JOIN raw_customers c ON c.customer_id = CAST(o.o_custkey AS VARCHAR)
  WHERE o.o_orderdate < {AS_OF_TS}
    AND {z('o.o_orderdate')} >= c.signup_date
    AND (c.churn_date IS NULL OR {z('o.o_orderdate')} <= c.churn_date)
),
raw_gtm_opportunities AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS opp_id,
         c.customer_id,
         CASE WHEN o.o_orderstatus = 'F' THEN CASE WHEN o.o_orderkey % 5 < 3 THEN 'closed_won' ELSE 'closed_lost' END
              WHEN o.o_orderstatus = 'P' THEN 'proposal'
              ELSE CASE WHEN o.o_orderkey % 5 < 3 THEN 'qualification' ELSE 'prospecting' END END AS stage,
         {z('o.o_orderdate')} AS close_date,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS amount,
         'rep_' || CAST(o.o_orderkey % 20 AS VARCHAR) AS sales_owner,
         CASE WHEN o.o_orderkey % 2 = 0 THEN 'expansion' ELSE 'new_business' END AS opportunity_type
  FROM orders o JOIN raw_customers c ON c.customer_id = CAST(o.o_custkey AS VARCHAR)
  WHERE o.o_orderdate < {AS_OF_TS} AND o.o_orderkey % 3 = 0
),
raw_line_share AS (
  SELECT o.o_custkey, count(*) AS n_lines, count(*) FILTER (WHERE l.l_returnflag = 'R') AS n_returned
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey
),
raw_pending AS (
  SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending FROM orders GROUP BY o_custkey
),
raw_risk_signals AS (
  SELECT c.customer_id,
         CAST(coalesce(least(1.0, 1.5 * (CAST(ls.n_returned AS DOUBLE) / ls.n_lines)), 0.0) AS FLOAT) AS compliance_gap_score,
         CAST(coalesce(p.n_pending, 0) AS INTEGER) AS vendor_risk_flags
  FROM raw_customers c
  LEFT JOIN raw_line_share ls ON CAST(ls.o_custkey AS VARCHAR) = c.customer_id
  LEFT JOIN raw_pending p ON CAST(p.o_custkey AS VARCHAR) = c.customer_id
),
raw_expansion_outreach_log AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS outreach_id,
         c.customer_id,
         {z('o.o_orderdate')} AS contacted_date,
         CAST((o.o_orderkey % 100) / 100 AS FLOAT) AS propensity_at_outreach,
         (['email', 'phone', 'in_app', 'qbr'])[CAST((o.o_orderkey // 4) % 4 AS INTEGER) + 1] AS outreach_channel,
         CASE WHEN o.o_orderstatus = 'F' THEN 'upgraded' WHEN o.o_orderstatus = 'O' THEN 'active'
              ELSE 'no_response' END AS outcome
  FROM orders o JOIN raw_customers c ON c.customer_id = CAST(o.o_custkey AS VARCHAR)
  WHERE o.o_orderdate < {AS_OF_TS} AND o.o_orderpriority = '5-LOW' AND o.o_orderkey % 4 = 0
)"""

def _any(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# the vocabularies of the rules, written out here so that a
# wrong list in the code under test does not pass on both sides
HIGH = ["high", "critical"]
CLOSED = ["closed_won", "closed_lost"]
RETENTION_EVENTS = ["integration_connect", "api_call", "monitoring_run"]

_DAYS_TO_CHURN = "c.churn_date - t.created_date"
STAGING = f"""
stg_customers AS (
  SELECT customer_id, industry, plan_tier, signup_date, mrr, churn_date, upgrade_date,
         ended IS NULL AS is_active, upgrade_date IS NOT NULL AS is_upgraded,
         coalesce(ended, {AS_OF}) - signup_date AS tenure_days, signup_date >= {AS_OF} - 90 AS is_early_stage
  FROM (SELECT *, churn_date AS ended FROM raw_customers)
),
stg_usage_events AS (
  SELECT u.* EXCLUDE ("timestamp"), u."timestamp" AS event_timestamp, coalesce(k.retention, FALSE) AS is_retention_signal,
         coalesce(k.trial, FALSE) AS is_premium_trial, coalesce(k.lim, FALSE) AS is_feature_limit_hit
  FROM raw_usage_events u
  LEFT JOIN (VALUES ('integration_connect', TRUE, FALSE, FALSE), ('api_call', TRUE, FALSE, FALSE), ('monitoring_run', TRUE, FALSE, FALSE),
                    ('premium_feature_trial', FALSE, TRUE, FALSE), ('feature_limit_hit', FALSE, FALSE, TRUE)) k(event_type, retention, trial, lim)
    USING (event_type)
),
stg_support_tickets AS (
  SELECT t.*, {_any('t.priority', HIGH)} AS is_high_priority,
         {_any('t.priority', HIGH)} AND coalesce({_DAYS_TO_CHURN} >= 0 AND {_DAYS_TO_CHURN} <= 60, FALSE) AS is_churn_signal
  FROM raw_support_tickets t LEFT JOIN (SELECT customer_id, churn_date FROM raw_customers) c USING (customer_id)
),
stg_gtm_opportunities AS (
  SELECT * EXCLUDE (gone), is_open AND gone AS is_expansion_risk, is_open AND opportunity_type = 'expansion' AS is_open_expansion_opp
  FROM (SELECT *, NOT {_any('stage', CLOSED)} AS is_open,
               customer_id IN (SELECT customer_id FROM raw_customers WHERE churn_date IS NOT NULL) AS gone
        FROM raw_gtm_opportunities)
),
stg_risk_signals AS (
  SELECT customer_id, compliance_gap_score, vendor_risk_flags,
         (['low', 'medium', 'high'])[1 + CAST(compliance_gap_score >= 0.35 AS INTEGER) + CAST(compliance_gap_score >= 0.70 AS INTEGER)] AS risk_tier
  FROM raw_risk_signals
),
stg_expansion_outreach AS (
  SELECT *, outcome = 'upgraded' AS is_converted, {AS_OF} - contacted_date AS days_since_outreach FROM raw_expansion_outreach_log
)"""

# One stream of dated facts serves every feature set. A feature is a name, an
# aggregate and a condition on a fact: its age (days before the reference date)
# and how many days after signup it fell.
FACTS = """
facts AS (
  SELECT customer_id, CAST("timestamp" AS DATE) AS day, event_type AS what, TRUE AS is_event, feature_adoption_score AS adoption,
         NULL::INTEGER AS hours, NULL AS topic
  FROM raw_usage_events
  UNION ALL
  SELECT customer_id, created_date, priority, FALSE, NULL, resolution_time, topic FROM raw_support_tickets
)"""

COUNTED = {
    "total_events": "is_event",
    "events_last_30d": "is_event AND age <= 30",
    "events_last_7d": "is_event AND age <= 7",
    "retention_signal_count": f"is_event AND {_any('what', RETENTION_EVENTS)}",
    "integration_connects_first_30d": "is_event AND what = 'integration_connect' AND since_signup <= 30",
    "tickets_last_30d": "NOT is_event AND age <= 30",
    "high_priority_tickets": f"NOT is_event AND {_any('what', HIGH)}",
    "premium_feature_trials_30d": "is_event AND what = 'premium_feature_trial' AND age <= 30",
    "feature_limit_hit_30d": "is_event AND what = 'feature_limit_hit' AND age <= 30",
    "feature_request_tickets_90d": "NOT is_event AND topic = 'feature_request' AND age <= 90",
}


def features_of(reference: str, known: str = "TRUE", counted: dict[str, str] = COUNTED) -> str:
    """Features of every row of ``reference`` (customer_id, signup_date, ref_day) from
    the facts that satisfy ``known``."""
    counts = ",\n         ".join(f"count(*) FILTER (WHERE {cond}) AS {name}" for name, cond in counted.items())
    return f"""
  SELECT customer_id, {counts},
         coalesce(avg(adoption), 0) AS avg_adoption_score, coalesce(avg(hours), 0) AS avg_resolution_hours,
         min(age) FILTER (WHERE is_event) AS last_event_age
  FROM (SELECT r.customer_id, f.*, r.ref_day - f.day AS age, f.day - r.signup_date AS since_signup
        FROM (SELECT customer_id, signup_date, ref_day FROM {reference}) r
        LEFT JOIN (SELECT customer_id AS owner, * EXCLUDE (customer_id) FROM facts) f ON f.owner = r.customer_id AND ({known}))
  GROUP BY customer_id"""


# flag, weight in the score, label among the drivers ('' if none), condition
FLAGS = [
    ("flag_very_low_events", "0.18", "low_events", "events_last_30d < 5"),
    ("flag_zero_recent_events", "0.20", "zero_7d_events", "events_last_7d = 0"),
    ("flag_low_adoption", "0.15", "low_adoption", "avg_adoption_score < 0.25"),
    ("flag_inactive_2w", "0.12", "inactive_14d", "days_since_last_event > 14"),
    ("flag_high_support_load", "0.12", "support_overload", "high_priority_tickets >= 2"),
    ("flag_ticket_surge", "0.08", "", "tickets_last_30d >= 5"),
    ("flag_early_stage_at_risk", "0.15", "onboarding_at_risk", "is_early_stage AND events_last_30d < 3"),
    ("flag_low_onboarding", "0.10", "low_integration", "tenure_days <= 90 AND activated_at_30d = 0"),
    ("flag_no_retention_signals", "0.10", "", "retention_signal_count = 0"),
]
_FLAG_ROWS = ", ".join(f"{{'name': '{n}', 'weight': CAST({w} AS DECIMAL(4,2)), 'label': '{lab}', 'place': {k}, 'up': {cond}}}"
                       for k, (n, w, lab, cond) in enumerate(FLAGS))
_CHURN_COLUMNS = ["total_events", "events_last_30d", "events_last_7d", "avg_adoption_score", "days_since_last_event", "retention_signal_count",
                  "integration_connects_first_30d", "activated_at_30d", "tickets_last_30d", "high_priority_tickets", "avg_resolution_hours"]

# lower and upper monthly revenue of a plan, between which a customer outgrows it
PLAN_BANDS = "(VALUES ('starter', 500.0, 2000.0), ('growth', 2000.0, 8000.0), ('enterprise', 8000.0, 50000.0)) band(plan_tier, low, high)"


def outgrown(mrr: str) -> str:
    return f"coalesce(least(1.0, greatest(0.0, (CAST({mrr} AS DOUBLE) - band.low) / (band.high - band.low))), 0.0)"


def saturating(count: str, full: int) -> str:
    """1 once the count reaches ``full``, on a log scale."""
    return f"least(1.0, ln(1 + {count}) / ln({full + 1}.0))"


MARTS = FACTS + f""",
seen_today AS ({features_of(f"(SELECT customer_id, signup_date, {AS_OF} AS ref_day FROM stg_customers)")}),
all_features AS (
  SELECT c.customer_id, c.industry, c.plan_tier, c.mrr, c.tenure_days, c.is_early_stage, c.is_active, c.is_upgraded,
         f.* EXCLUDE (customer_id), coalesce(f.last_event_age, c.tenure_days) AS days_since_last_event,
         CAST(f.integration_connects_first_30d >= 3 AS INTEGER) AS activated_at_30d
  FROM stg_customers c JOIN seen_today f USING (customer_id)
),
mart_churn AS (
  SELECT customer_id, industry, plan_tier, mrr, tenure_days, is_early_stage, {", ".join(_CHURN_COLUMNS)}
  FROM all_features WHERE is_active
),
raised AS (SELECT customer_id, unnest([{_FLAG_ROWS}], recursive := true) FROM mart_churn),
summed AS (
  SELECT customer_id, CAST(count(*) FILTER (WHERE up) AS INTEGER) AS risk_flag_count,
         CAST(least(1.0, 0.10 + coalesce(sum(weight) FILTER (WHERE up), 0)) AS DECIMAL(6,4)) AS score,
         array_to_string((list(label ORDER BY place) FILTER (WHERE up AND label <> ''))[1:2], ', ') AS drivers,
         {", ".join(f"bool_or(up) FILTER (WHERE name = '{n}') AS {n}" for n, _, _, _ in FLAGS)}
  FROM raised GROUP BY customer_id
),
mart_risk AS (
  SELECT customer_id, industry, plan_tier, mrr, 12 * mrr AS arr, tenure_days, is_early_stage, events_last_30d, events_last_7d,
         avg_adoption_score, days_since_last_event, retention_signal_count, integration_connects_first_30d,
         tickets_last_30d, high_priority_tickets, avg_resolution_hours, risk_flag_count, score AS churn_score,
         (['low', 'medium', 'high', 'critical'])[1 + CAST(score >= 0.25 AS INTEGER) + CAST(score >= 0.50 AS INTEGER) + CAST(score >= 0.75 AS INTEGER)] AS risk_tier,
         round(12 * mrr * score, 2) AS arr_at_risk, round(12 * mrr * score / 10, 2) AS intervention_value_10pct,
         coalesce(drivers, '') AS top_risk_drivers, {", ".join(n for n, _, _, _ in FLAGS)}
  FROM mart_churn JOIN summed USING (customer_id)
),
pipeline_value AS (
  SELECT customer_id, bool_or(is_open_expansion_opp) AS has_open_expansion_opp,
         coalesce(sum(amount) FILTER (WHERE is_open_expansion_opp), 0) AS expansion_opp_amount
  FROM stg_gtm_opportunities GROUP BY customer_id
),
last_contact AS (SELECT customer_id, {AS_OF} - max(contacted_date) AS days_ago FROM stg_expansion_outreach GROUP BY customer_id),
wanted AS (
  SELECT a.is_active AND NOT a.is_upgraded AS is_candidate, a.customer_id, a.mrr, a.tenure_days, a.is_early_stage, {", ".join("a." + c for c in _CHURN_COLUMNS)}, a.plan_tier, a.industry,
         a.premium_feature_trials_30d, a.feature_request_tickets_90d, a.feature_limit_hit_30d,
         coalesce(v.has_open_expansion_opp, FALSE) AS has_open_expansion_opp, coalesce(v.expansion_opp_amount, 0.0) AS expansion_opp_amount,
         {outgrown('a.mrr')} AS mrr_tier_ceiling_pct,
         l.customer_id IS NOT NULL AS was_contacted, l.days_ago AS days_since_last_outreach
  FROM all_features a
  LEFT JOIN {PLAN_BANDS} USING (plan_tier) LEFT JOIN pipeline_value v USING (customer_id) LEFT JOIN last_contact l USING (customer_id)
),
mart_expansion AS (SELECT * EXCLUDE (is_candidate) FROM wanted WHERE is_candidate),
propensity AS (
  SELECT customer_id, was_contacted, days_since_last_outreach,
         least(1.0, greatest(0.0, 0.30 * {saturating('premium_feature_trials_30d', 10)} + 0.25 * {saturating('feature_limit_hit_30d', 10)}
           + 0.15 * {saturating('feature_request_tickets_90d', 5)} + 0.20 * CAST(has_open_expansion_opp AS INTEGER) + 0.10 * mrr_tier_ceiling_pct)) AS wants_more
  FROM mart_expansion
),
mart_quadrant AS (
  SELECT r.customer_id, r.churn_score AS churn_probability, wants_more AS upgrade_propensity_proxy,
         coalesce(CASE WHEN wants_more >= 0.50 THEN CASE WHEN r.churn_score >= 0.50 THEN 'Flight Risk' WHEN r.churn_score < 0.25 THEN 'Growth Engine' END
                       WHEN wants_more < 0.25 AND r.churn_score >= 0.50 THEN 'Churn Candidate' END, 'Stable Base') AS quadrant_label,
         r.arr_at_risk, r.mrr, r.plan_tier,
         CASE WHEN r.plan_tier = 'free' THEN 500.0 ELSE CAST(r.mrr AS DOUBLE) END * 12 * wants_more AS expected_arr_uplift_proxy,
         was_contacted, days_since_last_outreach
  FROM propensity JOIN mart_risk r USING (customer_id)
)"""


def with_ctes(body: str, extra: str = "") -> str:
    """Wrap a query body with every base CTE (DuckDB skips unused ones)."""
    body = body.strip()
    if body[:4].upper() == "WITH":
        # merge the body's own CTEs into ours: "WITH a AS (...) SELECT" -> ", a AS (...) SELECT"
        extra = (extra + "," if extra else "") + body[4:]
        ctes = ",".join([RAW, STAGING, MARTS])
        return f"WITH {ctes},\n{extra}"
    ctes = ",".join([RAW, STAGING, MARTS] + ([extra] if extra else []))
    return f"WITH {ctes}\n{body}"
