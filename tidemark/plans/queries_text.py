"""Text context assembly and guardrail checks over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date
from tidemark.operators import briefs as BR
from tidemark.operators import cohort as CO
from tidemark.operators import risk as RK
from tidemark.operators import scoring as SC
from tidemark.operators import text as TX
from tidemark.plans import oracle_misc as OM
from tidemark.plans import oracle_text as OX
from tidemark.plans.catalog import register, wh
from tidemark.plans.oracle_base import with_ctes
from tidemark.sources.driver_tables import read_table


def _docs(s, d):
    return read_table(s, d, "documents").select("doc_id", "text")


def _turns(s, d):
    return read_table(s, d, "conversations").select("conv_id", "turn", "role", "text")


def _unknown_docs(s, d):
    g = TX.churn_brief_guardrails(_docs(s, d), "text")
    return g.select("doc_id", F.array_join("flags", "|").alias("flags"), "n_flags", "confidence_score", "passed")


register("guard_unknown_feature", with_ctes(OX.UNKNOWN_DOCS))(_unknown_docs)
register("guard_confidence", with_ctes(OX.CONFIDENCE))(lambda s, d: TX.churn_brief_guardrails(_docs(s, d), "text").select(
    "doc_id", "n_flags", "confidence_score", "passed", "final_text"))


def _exp_status(s, d):
    t = _turns(s, d).where(F.col("role") == "assistant")
    n = F.size(TX.expansion_brief_flags(F.col("text"))).cast("long")
    return t.select("conv_id", "turn", n.alias("n_flags"), TX.expansion_status(n).alias("status"),
                    F.greatest(F.lit(0.0), 1.0 - 0.25 * n).alias("confidence_score"))


register("guard_expansion_status", with_ctes(OX.EXP_STATUS_TURNS))(_exp_status)
register("guard_probability", with_ctes(OX.STATED_PCT))(
    lambda s, d: _turns(s, d).select("conv_id", "turn", TX.stated_percentage(F.col("text")).alias("stated_pct")))
register("guard_scope_exceeded", with_ctes(OX.SCOPE))(
    lambda s, d: _turns(s, d).where(F.col("role") == "assistant").select(
        "conv_id", "turn", TX.scope_exceeded(F.col("text")).alias("scope_exceeded")))


def _scrub(s, d):
    doc = _docs(s, d)
    scrubbed = TX.scrub_email(F.col("text"))
    marks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("[REDACTED]"), F.lit("")))) / 10
    return doc.select("doc_id", (marks(scrubbed) - marks(F.col("text"))).cast("long").alias("n_redacted"),
                      scrubbed.alias("scrubbed"))


register("guard_scrub_email", with_ctes(OX.SCRUB))(_scrub)
register("guard_quality_rate", with_ctes(OX.QUALITY))(
    lambda s, d: _unknown_docs(s, d).agg(F.avg(F.when(F.col("n_flags") == 0, 1.0).otherwise(0.0))
                                         .alias("full_confidence_share"), F.count(F.lit(1)).alias("n_texts")))


def _split(s, d):
    """Documents carry no marker of their own: every second one gets it after its
    first line, so both branches are met; brief and draft are returned."""
    marked = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"^([^\n]*)\n", "$1\n[EMAIL_DRAFT] \n")).otherwise(F.col("text"))
    brief, draft = TX.split_email(marked)
    return _docs(s, d).select("doc_id", brief.alias("brief"), draft.alias("email_draft"))


register("brief_split_email", with_ctes(OX.SPLIT))(_split)


def _tone(s, d):
    """Assistant turns carry no customer: a turn is calibrated at the propensity of the
    candidate with the least id among those equal to the conversation's modulo 1000
    (none: no propensity, the text stays)."""
    q = wh(s, d).propensity_quadrant.groupBy((F.col("customer_id").cast("long") % 1000).alias("k")).agg(
        F.min_by(F.col("upgrade_propensity_proxy").cast("double"), F.col("customer_id").cast("long")).alias("propensity"))
    t = _turns(s, d).where(F.col("role") == "assistant").withColumn("k", F.col("conv_id") % 1000).join(q, "k", "left")
    return t.select("conv_id", "turn", "propensity", TX.calibrate_tone(F.col("text"), F.col("propensity")).alias("calibrated"))


register("guard_tone", with_ctes(OX.TONE))(_tone)

# ------------------------------------------------------------ context assembly per customer
register("ctx_events_by_type", with_ctes(OX.CTX["ctx_events_by_type"]))(
    lambda s, d: TX.events_by_type(wh(s, d).usage_events, K.ORDERS_AS_OF).select(
        "customer_id", F.array_join(F.transform(F.map_entries("events_last_30d_by_type"),
                                                lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
                                    ",").alias("events_last_30d_by_type")))
register("ctx_recent_tickets", with_ctes(OX.CTX["ctx_recent_tickets"]))(
    lambda s, d: TX.recent_tickets(wh(s, d).support_tickets, K.ORDERS_AS_OF).select(
        "customer_id", F.array_join(F.transform("tickets", lambda t: t["ticket_id"]), ",").alias("ticket_ids"),
        F.size("tickets").cast("long").alias("n_tickets")))
register("ctx_latest_open_opp", with_ctes(OX.CTX["ctx_latest_open_opp"]))(
    lambda s, d: TX.latest_open_opportunity(wh(s, d).gtm_opportunities))
register("ctx_tenure_text", with_ctes(OX.CTX["ctx_tenure_text"]))(
    lambda s, d: wh(s, d).stg_customers().select("customer_id", "tenure_days",
                                                 TX.tenure_text(F.col("tenure_days")).alias("tenure_text")))


def _briefs(s, d):
    """Gate, propensity summary and facts block for every expansion candidate."""
    sc = SC.expansion_scoring(wh(s, d).propensity_quadrant)
    r = wh(s, d).risk_scores.select("customer_id", "mrr", "tenure_days", "churn_score", "top_risk_drivers")
    j = sc.join(r, "customer_id")
    return j.select("customer_id", TX.brief_gate(F.col("propensity")).alias("gate"),
                    TX.propensity_summary(F.col("propensity"), F.col("target_tier"), F.col("expected_arr_uplift"))
                    .alias("propensity_summary"),
                    TX.facts_block(F.col("plan_tier"), F.col("mrr"), F.col("tenure_days"), F.col("churn_score"),
                                   F.col("top_risk_drivers")).alias("facts"))


register("brief_gate_and_summary", with_ctes(OX.BRIEFS, OX.BRIEF_CTES))(_briefs)


def _brief_check(s, d):
    """The guardrails applied to every generated facts block (probability and
    feature-name checks against the customer's own churn score)."""
    b = _briefs(s, d).join(wh(s, d).risk_scores.select("customer_id", "churn_score"), "customer_id")
    g = TX.churn_brief_guardrails(b, "facts", F.col("churn_score").cast("double"))
    return g.select("customer_id", "n_flags", "confidence_score", "passed")


def _probability_check(s, d):
    """Texts that state a percentage against a probability that is not theirs:
    every conversation turn is checked against the churn score of the customer
    whose id, modulo 1000, equals the conversation's (none: no mismatch)."""
    r = wh(s, d).risk_scores.groupBy((F.col("customer_id").cast("long") % 1000).alias("k")).agg(
        F.min_by(F.col("churn_score").cast("double"), F.col("customer_id").cast("long")).alias("p"))
    t = _turns(s, d).withColumn("k", F.col("conv_id") % 1000).join(r, "k", "left")
    flag = F.size(TX.probability_flag(F.col("text"), F.col("p")))
    return t.select("conv_id", "turn", F.col("p").alias("model_p"), TX.stated_percentage(F.col("text")).alias("stated_pct"),
                    (flag > 0).alias("mismatch"))


register("guard_probability_check", with_ctes(OX.PROBABILITY_CHECK))(_probability_check)


def _flight_reasons(s, d):
    """Customers that are flight risks, with the reason in words."""
    q = wh(s, d).propensity_quadrant
    c, p = F.col("churn_probability").cast("double"), F.col("upgrade_propensity_proxy").cast("double")
    return q.where(RK.flight_risk(c, p)).select("customer_id", RK.flight_risk_reason(c, p).alias("reason"))


register("flight_risk_reasons", with_ctes(OX.FLIGHT_REASONS))(_flight_reasons)


register("ctx_brief_guardrails", with_ctes(OX.BRIEF_CHECK, OX.BRIEF_CTES))(_brief_check)


def _segment_briefs(s, d):
    """One written brief per industry, for every candidate in it: it names all risk
    drivers found in the industry, presses, and drafts an e-mail with an id and jargon.
    A row's own features are its own drivers, so one text gets different flags."""
    q = wh(s, d).propensity_quadrant.select("customer_id", F.col("upgrade_propensity_proxy").cast("double").alias("propensity"))
    r = wh(s, d).risk_scores.select("customer_id", "industry", F.split("top_risk_drivers", ", ").alias("own_features"))
    rows = q.join(r, "customer_id")
    named = rows.select("industry", F.explode("own_features").alias("x")).where("x <> ''").groupBy("industry", "x").count() \
        .groupBy("industry").agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("named"))  # at most the nine driver names
    text = F.concat(F.lit("Urgent: talk to the "), F.col("industry"), F.lit(" accounts immediately about "), F.coalesce("named", F.lit("usage")),
                    F.lit(" and plan_tier.\n[EMAIL_DRAFT] Account 0f8fad5b-d9cb-469f-a165-70867728950e leads by XGBoost and SHAP."))
    return rows.join(named, "industry", "left").select("customer_id", "propensity", "own_features", text.alias("raw_text"))


register("guard_expansion_check", with_ctes(OX.EXPANSION_CHECK))(
    lambda s, d: BR.check_expansion_brief(_segment_briefs(s, d)).select(
        "customer_id", F.array_join("flags", "|").alias("flags"), "n_flags", "status", "confidence", "final_text", "email_draft"))


def _gate_text(s, d):
    sc = SC.expansion_scoring(wh(s, d).propensity_quadrant)
    return BR.gate(sc.select("customer_id", "propensity", "target_tier", "expected_arr_uplift")).select(
        "customer_id", "audience", "gate", "summary", "brief", "wants_email")


register("brief_gate_text", with_ctes(OX.GATE_TEXT, OX.BRIEF_CTES))(_gate_text)


def _facts_parts(s, d):
    """Every fact of a brief per active customer: attributed signals of the churn
    model, usage by type, newest tickets, latest open opportunity, cohort rate."""
    from tidemark.plans import queries_models as QM
    w = wh(s, d)
    features = QM.CHURN_X + ["plan_tier", "industry"]
    composite = RK.risk_composite(RK.usage_decay(w.customers, w.event_days, K.ORDERS_AS_OF), w.risk_signals).select(
        "customer_id", F.col("risk_score").alias("composite_risk"))
    usage = TX.events_by_type(w.usage_events, K.ORDERS_AS_OF).select("customer_id", F.transform(
        F.map_entries("events_last_30d_by_type"), lambda e: F.struct(e["key"].alias("event_type"), e["value"].alias("n"))).alias("usage"))
    opp = TX.latest_open_opportunity(w.gtm_opportunities).select("customer_id", F.struct("stage", "amount").alias("opportunity"))
    base = w.churn_features.join(w.risk_scores.select("customer_id", F.col("churn_score").cast("double").alias("churn_probability"),
                                                      RK.churn_action(F.col("churn_score")).alias("action")), "customer_id")
    base = base.join(QM._attr(s, d, "churn").select("customer_id", "top_features"), "customer_id").withColumn("signals", BR.ranked_signals(features))
    for more in (composite, CO.cohort_churn_rate_context(w.customers).select("customer_id", F.col("cohort_churn_rate").alias("cohort_rate")), usage,
                 TX.recent_tickets(w.support_tickets, K.ORDERS_AS_OF), opp):
        base = base.join(more, "customer_id", "left")
    return base


def _facts(s, d):
    """The facts text of every active customer, with the three leading drivers' names."""
    return _facts_parts(s, d).select("customer_id", BR.facts_text(lit_date(K.ORDERS_AS_OF)).alias("facts"),
                                     F.array_join(BR.driver_labels(F.col("top_features")), "; ").alias("drivers"))


register("ctx_facts_text")(_facts)
