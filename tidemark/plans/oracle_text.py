"""Independent DuckDB SQL for the text-context and guardrail queries."""

from __future__ import annotations

from tidemark.plans.oracle_base import AS_OF


# Python's whitespace set in RE2 syntax (RE2's \\s lacks \\v and the Unicode spaces)
PY_WS = "[\\s\\x{000b}\\x{001c}-\\x{001f}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


# the rules' vocabularies, written out here: fixed values
FEATURES = ("events_last_30d avg_adoption_score days_since_last_event high_priority_tickets retention_signal_count integration_connects_first_30d "
            "mrr tenure_days total_events tickets_last_30d avg_resolution_hours events_last_7d is_early_stage plan_tier industry "
            "premium_feature_trials_30d feature_request_tickets_90d has_open_expansion_opp expansion_opp_amount mrr_tier_ceiling_pct "
            "activated_at_30d feature_limit_hit_30d").split()
CHURN_ONLY = ("events_last_30d_by_type churn_probability risk_score risk_tier cohort_churn_rate compliance_gap_score vendor_risk_flags "
              "usage_decay_score").split()
HARMLESS = "plan_tier customer_id risk_tier churn_date sign_up follow_up well_known opt_in check_in log_in".split()
EXPANSION_HARMLESS = HARMLESS + ["next_tier", "upgrade_date"]
TECHNICAL = "xgboost shap shap_impact lightgbm sklearn propensity_score model_version".split()
URGENT = ["immediately", "urgent", "critical"]
SCOPE_PHRASE = "I cannot answer this from the available customer data."
NOTE = "⚠️ AI-generated. Requires human review."


def py_strip(col: str) -> str:
    return f"regexp_replace({col}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def _lst(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def flags_sql(src: str, key: str, allowed: list[str]) -> str:
    """Per row: '|'-joined distinct hallucinated tokens in first-seen order and their count."""
    return f"""
WITH toks AS (
  SELECT {key}, unnest(list_filter(string_split_regex(text, '{PY_WS}+'), lambda t: t <> '')) AS tok,
         unnest(range(1, len(list_filter(string_split_regex(text, '{PY_WS}+'), lambda t: t <> '')) + 1)) AS pos
  FROM {src}),
clean AS (SELECT {key}, pos, regexp_replace(tok, '^[.,;:!?()''"]+|[.,;:!?()''"]+$', '', 'g') AS t FROM toks),
hits AS (SELECT {key}, t, min(pos) AS first_pos FROM clean
         WHERE length(t) >= 8 AND regexp_full_match(t, '[a-z][a-z0-9]*(_[a-z0-9]+)+') AND t NOT IN {_lst(allowed)}
         GROUP BY 1, 2),
agg AS (SELECT {key}, string_agg('hallucinated_feature:' || t, '|' ORDER BY first_pos) AS flags, count(*) AS n
        FROM hits GROUP BY 1)"""


UNKNOWN_DOCS = flags_sql("documents", "doc_id", FEATURES + CHURN_ONLY + HARMLESS) + """
SELECT d.doc_id, coalesce(a.flags, '') AS flags, coalesce(a.n, 0) AS n_flags,
       greatest(0.0, 1.0 - 0.2 * coalesce(a.n, 0)) AS confidence_score, coalesce(a.n, 0) = 0 AS passed
FROM documents d LEFT JOIN agg a USING (doc_id)"""

EXP_STATUS_TURNS = flags_sql("(SELECT conv_id * 100000 + turn AS k, text FROM conversations WHERE role = 'assistant')", "k",
                             FEATURES + EXPANSION_HARMLESS + TECHNICAL) + """
SELECT c.conv_id, c.turn, coalesce(a.n, 0) AS n_flags,
       CASE WHEN coalesce(a.n, 0) >= 2 THEN 'REJECTED' WHEN coalesce(a.n, 0) = 1 THEN 'FLAGGED' ELSE 'PASSED' END AS status,
       greatest(0.0, 1.0 - 0.25 * coalesce(a.n, 0)) AS confidence_score
FROM conversations c LEFT JOIN agg a ON a.k = c.conv_id * 100000 + c.turn WHERE c.role = 'assistant'"""

STATED_PCT = """
SELECT conv_id, turn,
       CASE WHEN regexp_extract(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1) <> '' THEN CAST(regexp_extract(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE)
            WHEN regexp_extract(text, '(?i)(\\d+(?:\\.\\d+)?)\\s+percent\\b', 1) <> '' THEN CAST(regexp_extract(text, '(?i)(\\d+(?:\\.\\d+)?)\\s+percent\\b', 1) AS DOUBLE)
       END AS stated_pct
FROM conversations"""

SCOPE = f"""SELECT conv_id, turn, contains(lower(text), lower('{SCOPE_PHRASE}')) AS scope_exceeded
FROM conversations WHERE role = 'assistant'"""


def _scrub(col: str) -> str:
    out = f"regexp_replace({col}, '(?i)\\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\\b', '[REDACTED]', 'g')"
    for term in TECHNICAL:
        out = f"regexp_replace({out}, '(?i)\\b{term}\\b', '[REDACTED]', 'g')"
    return out


SCRUB = f"""SELECT doc_id, CAST((length({_scrub('text')}) - length(replace({_scrub('text')}, '[REDACTED]', ''))) / 10
                           - (length(text) - length(replace(text, '[REDACTED]', ''))) / 10 AS BIGINT) AS n_redacted,
       {_scrub('text')} AS scrubbed
FROM documents"""

QUALITY = flags_sql("documents", "doc_id", FEATURES + CHURN_ONLY + HARMLESS) + """
SELECT avg(CASE WHEN coalesce(a.n, 0) = 0 THEN 1.0 ELSE 0.0 END) AS full_confidence_share, count(*) AS n_texts
FROM documents d LEFT JOIN agg a USING (doc_id)"""

SPLIT = f"""WITH marked AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND contains(text, chr(10))
                      THEN split_part(text, chr(10), 1) || chr(10) || '[EMAIL_DRAFT] ' || substr(text, strpos(text, chr(10))) ELSE text END AS t FROM documents),
cut AS (SELECT doc_id, t, strpos(t, '[EMAIL_DRAFT]') AS place FROM marked)
SELECT doc_id, {py_strip("CASE WHEN place = 0 THEN t ELSE substr(t, 1, place - 1) END")} AS brief,
       CASE WHEN place > 0 THEN {py_strip("substr(t, place + 13)")} END AS email_draft FROM cut"""

PROBABILITY_CHECK = STATED_PCT.strip()
PROBABILITY_CHECK = f"""
SELECT conv_id, turn, p AS model_p, stated_pct, coalesce(abs(stated_pct - p * 100) > 2.0, FALSE) AS mismatch
FROM ({PROBABILITY_CHECK})
LEFT JOIN (SELECT CAST(customer_id AS BIGINT) % 1000 AS k, arg_min(CAST(churn_score AS DOUBLE), CAST(customer_id AS BIGINT)) AS p FROM mart_risk GROUP BY 1)
  ON k = conv_id % 1000"""

FLIGHT_REASONS = """
SELECT customer_id, 'Churn probability ' || CAST(round(CAST(churn_probability * 100 AS DECIMAL(38,10)), 0) AS INTEGER)
       || '% and upgrade propensity ' || CAST(round(CAST(upgrade_propensity_proxy * 100 AS DECIMAL(38,10)), 0) AS INTEGER)
       || '% both exceed 50% threshold. Restore account health before any upsell motion.' AS reason
FROM mart_quadrant WHERE quadrant_label = 'Flight Risk'"""

CTX = {
    "ctx_events_by_type": f"""SELECT customer_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS events_last_30d_by_type
FROM (SELECT customer_id, event_type, count(*) AS n FROM raw_usage_events
      WHERE "timestamp" >= CAST({AS_OF} - 30 AS TIMESTAMP) GROUP BY 1, 2) GROUP BY 1""",
    "ctx_recent_tickets": f"""SELECT customer_id, string_agg(ticket_id, ',' ORDER BY rk) AS ticket_ids, count(*) AS n_tickets
FROM (SELECT customer_id, ticket_id, row_number() OVER (PARTITION BY customer_id ORDER BY created_date DESC, ticket_id DESC) AS rk
      FROM raw_support_tickets WHERE resolution_time IS NULL OR created_date >= {AS_OF} - 90) WHERE rk <= 5 GROUP BY 1""",
    "ctx_latest_open_opp": """SELECT customer_id, opp_id, stage, CAST(amount AS DOUBLE) AS amount, close_date FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY close_date DESC, opp_id DESC) AS rn
  FROM raw_gtm_opportunities WHERE stage NOT IN ('closed_won', 'closed_lost')) WHERE rn = 1""",
    "ctx_tenure_text": """SELECT customer_id, tenure_days,
       CASE WHEN tenure_days // 365 > 0 THEN CAST(tenure_days // 365 AS VARCHAR) || 'y ' || CAST((tenure_days % 365) // 30 AS VARCHAR) || 'mo'
            ELSE CAST((tenure_days % 365) // 30 AS VARCHAR) || 'mo' END AS tenure_text FROM stg_customers""",
}


CONFIDENCE = flags_sql("documents", "doc_id", FEATURES + CHURN_ONLY + HARMLESS) + f"""
SELECT d.doc_id, coalesce(a.n, 0) AS n_flags, greatest(0.0, 1.0 - 0.2 * coalesce(a.n, 0)) AS confidence_score,
       coalesce(a.n, 0) = 0 AS passed,
       {py_strip('d.text')} || chr(10) || chr(10) || '{NOTE}' AS final_text
FROM documents d LEFT JOIN agg a USING (doc_id)"""


def _tone(col: str) -> str:
    out = col
    for phrase in URGENT:
        out = f"regexp_replace({out}, '(?i){phrase}', '', 'g')"
    return py_strip(f"regexp_replace({out}, '  +', ' ', 'g')")


TONE = f"""SELECT conv_id, turn, propensity, CASE WHEN propensity < 0.5 THEN {_tone('text')} ELSE text END AS calibrated
FROM conversations LEFT JOIN (
  SELECT CAST(customer_id AS BIGINT) % 1000 AS k, arg_min(CAST(upgrade_propensity_proxy AS DOUBLE), CAST(customer_id AS BIGINT)) AS propensity
  FROM mart_quadrant GROUP BY 1) ON k = conv_id % 1000
WHERE role = 'assistant'"""

from tidemark.plans.oracle_misc import MISC  # noqa: E402


def _tier_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.75 THEN 'critical' WHEN {x} >= 0.5 THEN 'high' "
            f"WHEN {x} >= 0.25 THEN 'medium' ELSE 'low' END")


def _pct0(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} * 100 AS DECIMAL(38,10)), 0) AS BIGINT) AS VARCHAR)"


def _tenure(x: str) -> str:
    return (f"CASE WHEN {x} // 365 > 0 THEN CAST({x} // 365 AS VARCHAR) || 'y ' || CAST(({x} % 365) // 30 AS VARCHAR) || 'mo' "
            f"ELSE CAST(({x} % 365) // 30 AS VARCHAR) || 'mo' END")


BRIEF_CTES = f"""
xs_b AS ({MISC['expansion_scoring'][0]}),
briefs AS (
  SELECT x.customer_id,
         CASE WHEN x.propensity < 0.15 THEN 'rejected' WHEN x.propensity < 0.35 THEN 'not_ready' ELSE 'eligible' END AS gate,
         'This account has ' || upper({_tier_sql('x.propensity')}) || ' expansion propensity (' || {_pct0('x.propensity')}
           || '%) toward ' || coalesce(x.target_tier, 'the next tier') || '. Expected ARR uplift: $'
           || format('{{:,.0f}}', round(x.expected_arr_uplift, 0)) || '.' AS propensity_summary,
         concat_ws(' | ', 'Plan: ' || upper(x.plan_tier), 'MRR: $' || format('{{:,.0f}}', round(CAST(r.mrr AS DOUBLE), 0)),
                   'Tenure: ' || {_tenure('r.tenure_days')},
                   'Churn risk: ' || {_pct0('r.churn_score')} || '% (' || {_tier_sql('r.churn_score')} || ')',
                   'Top signals: ' || CASE WHEN r.top_risk_drivers = '' THEN 'none' ELSE r.top_risk_drivers END) AS facts,
         CAST(r.churn_score AS DOUBLE) AS churn_score
  FROM xs_b x JOIN mart_risk r USING (customer_id))"""

BRIEFS = "SELECT customer_id, gate, propensity_summary, facts FROM briefs"

_PCT = "CASE WHEN regexp_extract(facts, '(\\d+(?:\\.\\d+)?)\\s*%', 1) <> '' THEN CAST(regexp_extract(facts, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) END"

BRIEF_CHECK = flags_sql("(SELECT customer_id, facts AS text FROM briefs)", "customer_id",
                        FEATURES + CHURN_ONLY + HARMLESS) + f"""
SELECT b.customer_id, n_flags, greatest(0.0, 1.0 - 0.2 * n_flags) AS confidence_score, n_flags = 0 AS passed
FROM (SELECT b.customer_id, coalesce(a.n, 0)
             + CASE WHEN {_PCT.replace('facts', 'b.facts')} IS NOT NULL
                     AND abs({_PCT.replace('facts', 'b.facts')} - b.churn_score * 100) > 2.0 THEN 1 ELSE 0 END AS n_flags
      FROM briefs b LEFT JOIN agg a USING (customer_id)) b"""


# A row's own drivers are allowed; the text of an industry names all of them.
EXPANSION_CHECK = f"""
WITH base AS (
  SELECT q.customer_id, CAST(q.upgrade_propensity_proxy AS DOUBLE) AS propensity, r.industry, string_split(r.top_risk_drivers, ', ') AS own
  FROM mart_quadrant q JOIN mart_risk r USING (customer_id)),
named AS (SELECT industry, string_agg(x, ', ' ORDER BY x) AS named FROM (SELECT DISTINCT industry, unnest(own) AS x FROM base) WHERE x <> '' GROUP BY 1),
told AS (
  SELECT customer_id, propensity, own,
         'Urgent: talk to the ' || industry || ' accounts immediately about ' || coalesce(named, 'usage') || ' and plan_tier.' AS brief
  FROM base LEFT JOIN named USING (industry)),
words AS (
  SELECT customer_id, own, w, pos FROM (
    SELECT customer_id, own, unnest(list_transform(string_split(brief, ' '), lambda t: trim(t, '.,;:!?()'))) AS w,
           unnest(range(len(string_split(brief, ' ')))) AS pos FROM told)
  WHERE length(w) >= 8 AND regexp_full_match(w, '[a-z][a-z0-9]*(_[a-z0-9]+)+') AND w NOT IN {_lst(FEATURES + EXPANSION_HARMLESS + TECHNICAL)}),
bad AS (
  SELECT customer_id, string_agg('hallucinated_feature:' || w, '|' ORDER BY pos) AS flags, count(*) AS n
  FROM (SELECT customer_id, w, min(pos) AS pos FROM words WHERE NOT list_contains(own, w) GROUP BY 1, 2) GROUP BY 1)
SELECT customer_id, coalesce(flags, '') AS flags, coalesce(n, 0) AS n_flags,
       CASE WHEN coalesce(n, 0) >= 2 THEN 'REJECTED' WHEN n = 1 THEN 'FLAGGED' ELSE 'PASSED' END AS status,
       CAST(greatest(0.0, 1.0 - 0.25 * coalesce(n, 0)) AS DOUBLE) AS confidence,
       CASE WHEN propensity < 0.5 THEN {_tone('brief')} ELSE brief END || chr(10) || chr(10) || '{NOTE}' AS final_text,
       'Account [REDACTED] leads by [REDACTED] and [REDACTED].' AS email_draft
FROM told LEFT JOIN bad USING (customer_id)"""

GATE_TEXT = f"""
SELECT b.customer_id, audience, b.gate,
       CASE b.gate WHEN 'eligible' THEN b.propensity_summary
                   WHEN 'not_ready' THEN 'Account not ready for outreach — propensity ' || {_pct0('x.propensity')} || '% is below the 35% threshold.' END AS summary,
       CASE WHEN b.gate = 'not_ready' THEN 'Account not ready for outreach. Propensity ' || {_pct0('x.propensity')} || '% (' || {_tier_sql('x.propensity')}
         || ') is below the activation threshold. Monitor for rising usage signals before scheduling an upgrade conversation toward '
         || coalesce(x.target_tier, 'N/A') || '.' || chr(10) || chr(10) || '{NOTE}' END AS brief,
       b.gate = 'eligible' AND audience <> 'csm' AS wants_email
FROM briefs b JOIN xs_b x USING (customer_id), (VALUES ('csm'), ('executive')) a(audience)"""
