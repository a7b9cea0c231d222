"""Account briefs as whole-table jobs: the facts a brief may state, the gate in
front of it, and the full check of a written one.

Every step is a built-in expression per row; attributed signals, tickets, usage by
type and cohort rates arrive as joined columns, each aggregated per customer first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import tier
from tidemark.operators import text as TX

# --- fixed values: plain names of model features, and the texts of the gate ------
FEATURE_LABELS = {
    "mrr": "Monthly revenue",
    "tenure_days": "Account age",
    "total_events": "Total product events (all time)",
    "events_last_30d": "Product activity in the last 30 days",
    "events_last_7d": "Product activity in the last 7 days",
    "avg_adoption_score": "Feature adoption rate",
    "days_since_last_event": "Days since last login",
    "retention_signal_count": "High-value actions (integrations, API calls, monitoring runs)",
    "integration_connects_first_30d": "Integrations connected in first 30 days",
    "tickets_last_30d": "Support tickets raised in the last 30 days",
    "high_priority_tickets": "High/critical priority tickets (all time)",
    "avg_resolution_hours": "Average support ticket resolution time",
    "plan_tier": "Commercial plan tier",
    "industry": "Industry vertical",
    "is_early_stage": "In onboarding window (first 90 days)",
    "premium_feature_trials_30d": "Premium feature trials in the last 30 days",
    "feature_request_tickets_90d": "Feature request tickets in the last 90 days",
    "has_open_expansion_opp": "Active expansion opportunity in Sales pipeline",
    "expansion_opp_amount": "Value of open expansion opportunity (USD)",
    "mrr_tier_ceiling_pct": "Tier ceiling pressure (% of the way to top of current tier)",
}
WHOLE_NUMBER_FEATURES = ["events_last_30d", "events_last_7d", "total_events", "tenure_days", "days_since_last_event", "retention_signal_count",
                         "integration_connects_first_30d", "tickets_last_30d", "high_priority_tickets"]
NOT_READY_SUMMARY = "Account not ready for outreach — propensity {p}% is below the 35% threshold."
NOT_READY_BRIEF = ("Account not ready for outreach. Propensity {p}% ({tier}) is below the activation threshold. "
                   "Monitor for rising usage signals before scheduling an upgrade conversation toward {target}.")
AUDIENCES = ["csm", "executive"]
NO_EMAIL_AUDIENCE = "csm"


def label(feature: Column) -> Column:
    """The plain name of a feature, itself if it has none."""
    names = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(names, feature), feature)


def value_map(features: list[str]) -> Column:
    """feature -> its value as text: whole numbers, else two decimals; text as it is."""
    def shown(f: str) -> Column:
        if f in ("plan_tier", "industry"):
            return F.col(f).cast("string")
        return F.format_string("%.0f" if f in WHOLE_NUMBER_FEATURES else "%.2f", F.col(f).cast("double"))
    return F.create_map(*[x for f in features for x in (F.lit(f), shown(f))])


def ranked_signals(features: list[str], top: int = 5) -> Column:
    """The ``top`` attributed features of a row (``top_features``: feature and
    contribution, strongest first) with label, direction and shown value."""
    values = value_map(features)
    return F.transform(F.slice("top_features", 1, top), lambda t: F.struct(
        t["feature"].alias("feature"), label(t["feature"]).alias("label"),
        F.when(t["contribution"] > 0, "increases").otherwise("reduces").alias("direction"),
        F.element_at(values, t["feature"]).alias("value")))


def _lines(items: Column, line) -> Column:
    listed = F.array_join(F.transform(items, line), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, listed).otherwise("- none")


def facts_text(as_of: Column) -> Column:
    """The verified facts of a row as text. Reads: industry, plan_tier, mrr,
    tenure_days, is_early_stage, churn_probability, composite_risk, action,
    cohort_rate, signals (ranked_signals), usage (array of event_type, n), tickets
    (newest first: status, topic, priority, created_date), opportunity (stage, amount)."""
    def percent(c: str) -> Column:
        return F.concat(F.format_string("%.1f", F.col(c).cast("double") * 100), F.lit("%"))

    def money(c: Column) -> Column:
        return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))
    early = F.when(F.col("is_early_stage"), "yes (first 90 days)").otherwise("no")
    p = F.col("churn_probability").cast("double")
    parts = [
        F.concat(F.lit("Account: "), F.col("industry"), F.lit(", "), F.col("plan_tier"), F.lit(" plan, MRR "), money(F.col("mrr")), F.lit(", ARR "),
                 money(F.col("mrr") * 12), F.lit(", tenure "), TX.tenure_text(F.col("tenure_days")), F.lit(", onboarding: "), early),
        F.concat(F.lit("Churn outlook: "), percent("churn_probability"), F.lit(" ("), F.upper(tier(p)), F.lit("), compliance and usage risk "),
                 percent("composite_risk"), F.lit(", cohort rate "), percent("cohort_rate")),
        F.concat(F.lit("Action: "), F.col("action")),
        F.lit("Signals:"),
        _lines(F.col("signals"), lambda s: F.concat(F.lit("- "), s["label"], F.lit(": "), s["direction"], F.lit(" churn risk (value "), s["value"], F.lit(")"))),
        F.lit("Usage, last 30 days:"),
        _lines(F.col("usage"), lambda u: F.concat(F.lit("- "), u["event_type"], F.lit(": "), u["n"].cast("string"))),
        F.lit("Tickets, newest first:"),
        _lines(F.col("tickets"), lambda t: F.concat(F.lit("- ["), F.upper(t["status"]), F.lit("] "), t["topic"], F.lit(", priority "), t["priority"], F.lit(", "),
                                                   F.datediff(as_of, t["created_date"]).cast("string"), F.lit(" days ago"))),
        F.when(F.col("opportunity").isNull(), "Opportunity: none").otherwise(
            F.concat(F.lit("Opportunity: "), F.col("opportunity.stage"), F.lit(", "), money(F.col("opportunity.amount"))))]
    return F.concat_ws("\n", *parts)


def gate(df: DataFrame) -> DataFrame:
    """What each audience gets for a row (propensity, target_tier,
    expected_arr_uplift): below 0.15 nothing, below 0.35 the not-ready texts, else the
    summary; an e-mail draft only if ready and not for the CSM."""
    p = F.col("propensity")
    state = TX.brief_gate(p)
    pct, target = TX.pct0(p).cast("string"), F.coalesce("target_tier", F.lit("N/A"))

    def fill(template: str) -> Column:
        fields = {"{p}": pct, "{tier}": tier(p), "{target}": target}
        out = F.lit(template)
        for mark, value in fields.items():
            out = F.replace(out, F.lit(mark), value) if mark in template else out
        return out
    rows = df.withColumn("audience", F.explode(F.array(*[F.lit(a) for a in AUDIENCES]))).withColumn("gate", state)
    ready = F.col("gate") == "eligible"
    return rows.withColumn("summary", F.when(F.col("gate") == "not_ready", fill(NOT_READY_SUMMARY)).when(
        ready, TX.propensity_summary(p, F.col("target_tier"), F.col("expected_arr_uplift")))).withColumn(
        "brief", F.when(F.col("gate") == "not_ready", F.concat(fill(NOT_READY_BRIEF), F.lit("\n\n" + TX.WATERMARK)))).withColumn(
        "wants_email", ready & (F.col("audience") != NO_EMAIL_AUDIENCE))


def driver_labels(top_features: Column, n: int = 3) -> Column:
    return F.transform(F.slice(top_features, 1, n), lambda t: label(t["feature"]))


def check_expansion_brief(df: DataFrame, raw: str = "raw_text", own: str = "own_features", propensity: str = "propensity") -> DataFrame:
    """The full check of a written brief per row: the text is cut at its e-mail
    marker; feature-like words that are neither known nor the row's ``own`` features
    are flagged (set difference on arrays); flags give status and confidence; urgency
    goes where the row's propensity is under one half; ids and jargon are
    blotted out of the draft; the watermark is added."""
    brief, draft = TX.split_email(F.col(raw))
    out = df.withColumn("_brief", brief).withColumn("_draft", draft)
    out = out.withColumn("flags", TX.expansion_brief_flags(F.col("_brief"), F.col(own))).withColumn("n_flags", F.size("flags").cast("long"))
    return out.withColumn("status", TX.expansion_status(F.col("n_flags"))).withColumn(
        "confidence", F.greatest(F.lit(0.0), 1.0 - 0.25 * F.col("n_flags"))).withColumn(
        "final_text", F.concat(TX.calibrate_tone(F.col("_brief"), F.col(propensity)), F.lit("\n\n" + TX.WATERMARK))).withColumn(
        "email_draft", TX.scrub_email(F.col("_draft"))).drop("_brief", "_draft")
