"""Text: context assembly for briefs and the rule checks on written text.

All checks are built-in column expressions over whole texts; no Python per row.
Higher-order array functions are interpreted, so regular expressions narrow a
text to its few candidates first.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date, tier

# --- fixed values: guardrail vocabularies and texts -----------------------------
KNOWN_FEATURES = [
    "events_last_30d", "avg_adoption_score", "days_since_last_event", "high_priority_tickets",
    "retention_signal_count", "integration_connects_first_30d", "mrr", "tenure_days", "total_events",
    "tickets_last_30d", "avg_resolution_hours", "events_last_7d", "is_early_stage", "plan_tier", "industry",
    "events_last_30d_by_type", "churn_probability", "risk_score", "risk_tier", "cohort_churn_rate",
    "compliance_gap_score", "vendor_risk_flags", "usage_decay_score", "premium_feature_trials_30d",
    "feature_request_tickets_90d", "has_open_expansion_opp", "expansion_opp_amount", "mrr_tier_ceiling_pct",
    "activated_at_30d", "feature_limit_hit_30d",
]
SAFE_TOKENS = ["plan_tier", "customer_id", "risk_tier", "churn_date", "sign_up", "follow_up", "well_known",
               "opt_in", "check_in", "log_in"]
EXPANSION_KNOWN_FEATURES = [
    "mrr", "tenure_days", "total_events", "events_last_30d", "events_last_7d", "avg_adoption_score",
    "days_since_last_event", "retention_signal_count", "integration_connects_first_30d", "tickets_last_30d",
    "high_priority_tickets", "avg_resolution_hours", "plan_tier", "industry", "is_early_stage",
    "premium_feature_trials_30d", "feature_request_tickets_90d", "has_open_expansion_opp",
    "expansion_opp_amount", "mrr_tier_ceiling_pct", "activated_at_30d", "feature_limit_hit_30d",
]
EXPANSION_SAFE_TOKENS = SAFE_TOKENS + ["next_tier", "upgrade_date"]
EXPANSION_TECHNICAL_TERMS = ["xgboost", "shap", "shap_impact", "lightgbm", "sklearn", "propensity_score",
                             "model_version"]
URGENCY_PHRASES = ["immediately", "urgent", "critical"]
WATERMARK = "⚠️ AI-generated. Requires human review."
SCOPE_EXCEEDED_PHRASE = "I cannot answer this from the available customer data."
EMAIL_MARKER = "[EMAIL_DRAFT]"
FEATURE_PATTERN = r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"  # checked part by part, see is_feature_token
UUID_PATTERN = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
STRIP_SET = "[.,;:!?()'\"]"
# characters Python's str.split()/str.strip() treat as whitespace (str.isspace)
PY_WS = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
PY_WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
MIN_PROPENSITY_FOR_API = 0.15
MIN_PROPENSITY_FOR_BRIEF = 0.35


def py_strip(c: Column) -> Column:
    """str.strip(): remove leading/trailing whitespace of every kind (F.trim alone removes
    spaces only). Only the ends of a text are compared with the set."""
    return F.btrim(c, F.lit(PY_WS_CHARS))


def _arr(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_feature_token(t: Column) -> Column:
    """Does the whole token match FEATURE_PATTERN? In parts without repeated groups,
    whose matching takes a stack frame a repeat."""
    return t.rlike("^[a-z][a-z0-9_]*+$") & t.contains("_") & ~t.contains("__") & ~t.endswith("_")


def feature_tokens(text: Column) -> Column:
    """Distinct snake_case tokens (>= 8 characters) of a text, in first-seen order; a
    word may have punctuation (STRIP_SET) at its ends.

    A text without an underscore has none and is not scanned. Else one linear scan: a
    match begins where a word does (the ASCII test is the same, only cheaper, and comes
    first), and what was read is never given back."""
    word = PY_WS.replace("[", "[^", 1)
    pattern = rf"(?<![!-~])(?<!{word}){STRIP_SET}*+([a-z][a-z0-9]*+_[a-z0-9_]*+){STRIP_SET}*+(?!{word})"
    toks = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: (F.length(t) >= 8) & is_feature_token(t)))
    return F.when(~text.contains("_"), F.array().cast("array<string>")).otherwise(toks)


def unknown_feature_flags(text: Column, allowed: list[str], also_skip: list[str] | None = None, row_allowed: Column | None = None) -> Column:
    """Feature-like tokens of the text that are neither in the allowed lists nor in
    the row's own list ``row_allowed`` (an array column)."""
    skip = _arr(allowed + (also_skip or []))
    if row_allowed is not None:
        skip = F.array_union(skip, F.coalesce(row_allowed, F.array().cast("array<string>")))
    return F.transform(F.array_except(feature_tokens(text), skip), lambda t: F.concat(F.lit("hallucinated_feature:"), t))


def stated_percentage(text: Column) -> Column:
    """First 'N %' in the text, else first 'N percent' (case-insensitive), as double.
    A number is tried from its first digit only: linear in the text."""
    number = r"(?<!\d)(\d++(?:\.\d++)?+)"
    pct = F.regexp_extract(text, number + r"\s*+%", 1)
    word = F.regexp_extract(text, rf"(?i){number}\s++percent\b", 1)
    return F.when(pct != "", pct.cast("double")).when(word != "", word.cast("double"))


def probability_flag(text: Column, model_p: Column, tolerance_pp: float = 2.0) -> Column:
    s = stated_percentage(text)
    return F.when(s.isNotNull() & (F.abs(s - model_p * 100) > tolerance_pp), F.array(F.lit("probability_mismatch"))) \
            .otherwise(F.array().cast("array<string>"))


def churn_brief_guardrails(df: DataFrame, text_col: str, model_p: Column | None = None) -> DataFrame:
    flags = unknown_feature_flags(F.col(text_col), KNOWN_FEATURES, SAFE_TOKENS)
    if model_p is not None:
        flags = F.concat(flags, probability_flag(F.col(text_col), model_p))
    # n_flags reads the column: from the expression, whose lambdas are new each time, the text would be scanned twice
    return df.withColumn("flags", flags).withColumn("n_flags", F.size("flags").cast("long")) \
             .withColumn("confidence_score", F.greatest(F.lit(0.0), 1.0 - 0.2 * F.col("n_flags"))) \
             .withColumn("passed", F.col("n_flags") == 0) \
             .withColumn("final_text", F.concat(py_strip(F.col(text_col)), F.lit("\n\n" + WATERMARK)))


def expansion_status(n_flags: Column) -> Column:
    return F.when(n_flags >= 2, "REJECTED").when(n_flags == 1, "FLAGGED").otherwise("PASSED")


def expansion_brief_flags(text: Column, top_features: Column | None = None) -> Column:
    """Flags of an expansion brief; the row's own attributed features are allowed too."""
    return unknown_feature_flags(text, EXPANSION_KNOWN_FEATURES + EXPANSION_SAFE_TOKENS + EXPANSION_TECHNICAL_TERMS, row_allowed=top_features)


def calibrate_tone(text: Column, propensity: Column) -> Column:
    """Drop urgency words when propensity < 0.5, collapse double spaces, strip."""
    stripped = text
    for phrase in URGENCY_PHRASES:
        stripped = F.regexp_replace(stripped, f"(?i){phrase}", "")
    stripped = py_strip(F.regexp_replace(stripped, "  +", " "))
    return F.when(propensity < 0.5, stripped).otherwise(text)


def scrub_email(text: Column) -> Column:
    out = F.regexp_replace(text, UUID_PATTERN, "[REDACTED]")
    for term in EXPANSION_TECHNICAL_TERMS:
        out = F.regexp_replace(out, rf"(?i)\b{term}\b", "[REDACTED]")
    return out


def split_email(text: Column) -> tuple[Column, Column]:
    """(brief, email draft) cut at the first marker; draft is NULL without one."""
    parts = F.split(text, r"\[EMAIL_DRAFT\]", 2)
    return py_strip(parts[0]), F.when(F.size(parts) > 1, py_strip(parts[1]))


def scope_exceeded(answer: Column) -> Column:
    return F.lower(answer).contains(SCOPE_EXCEEDED_PHRASE.lower())


def tenure_text(days: Column) -> Column:
    y = F.floor(days / 365)
    m = F.floor((days % 365) / 30)
    return F.when(y > 0, F.format_string("%dy %dmo", y.cast("int"), m.cast("int"))) \
            .otherwise(F.format_string("%dmo", m.cast("int")))


def events_by_type(events: DataFrame, as_of: _dt.date) -> DataFrame:
    """30-day event counts per type as a map per customer. Pre-aggregated per
    (customer, type) first, so each map is built from <= 8 rows."""
    e = events.where(F.col("timestamp") >= F.date_sub(lit_date(as_of), 30).cast("timestamp"))
    g = e.groupBy("customer_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("customer_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("events_last_30d_by_type"))


def recent_tickets(tickets: DataFrame, as_of: _dt.date, k: int = 5) -> DataFrame:
    """The k newest tickets that are open or created within 90 days, per customer
    (row_number <= k: Spark applies a partial group limit before the shuffle)."""
    from pyspark.sql import Window
    t = tickets.where(F.col("resolution_time").isNull() | (F.col("created_date") >= F.date_sub(lit_date(as_of), 90)))
    w = Window.partitionBy("customer_id").orderBy(F.col("created_date").desc(), F.col("ticket_id").desc())
    t = t.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return t.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct(
        "rk", "ticket_id", "created_date", "priority", "topic",
        F.when(F.col("resolution_time").isNull(), "open").otherwise("resolved").alias("status")))).alias("tickets"))


def latest_open_opportunity(opps: DataFrame) -> DataFrame:
    o = opps.where(~F.col("stage").isin(*K.CLOSED_STAGES))
    return o.groupBy("customer_id").agg(F.max_by(F.struct("opp_id", "stage", "amount", "close_date"),
                                                 F.struct("close_date", "opp_id")).alias("o")) \
            .select("customer_id", "o.opp_id", "o.stage", "o.amount", "o.close_date")


def brief_gate(propensity: Column) -> Column:
    return (F.when(propensity < MIN_PROPENSITY_FOR_API, "rejected")
             .when(propensity < MIN_PROPENSITY_FOR_BRIEF, "not_ready").otherwise("eligible"))


def pct0(p: Column) -> Column:
    return F.round((p * 100).cast("decimal(38,10)"), 0).cast("long")


def propensity_summary(propensity: Column, target: Column, uplift: Column) -> Column:
    return F.concat(F.lit("This account has "), F.upper(tier(propensity)), F.lit(" expansion propensity ("),
                    pct0(propensity).cast("string"), F.lit("%) toward "), F.coalesce(target, F.lit("the next tier")),
                    F.lit(". Expected ARR uplift: $"), F.format_number(F.round(uplift, 0), 0), F.lit("."))


def facts_block(plan: Column, mrr: Column, tenure_days: Column, churn_p: Column, drivers: Column) -> Column:
    """Verified facts rendered as text (what a brief may state)."""
    return F.concat_ws(" | ", F.concat(F.lit("Plan: "), F.upper(plan)),
                       F.concat(F.lit("MRR: $"), F.format_number(F.round(mrr.cast("double"), 0), 0)),
                       F.concat(F.lit("Tenure: "), tenure_text(tenure_days)),
                       F.concat(F.lit("Churn risk: "), pct0(churn_p).cast("string"), F.lit("% ("), tier(churn_p),
                                F.lit(")")),
                       F.concat(F.lit("Top signals: "),
                                F.when(drivers == "", F.lit("none")).otherwise(drivers)))
