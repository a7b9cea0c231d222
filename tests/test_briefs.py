"""Facts text, gate and full check of briefs against plain renderings."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from tidemark.functions.columns import lit_date
from tidemark.operators import briefs as BR
from tidemark.operators import text as TX
from tidemark.plans.catalog import wh

AS_OF = dt.date(2001, 8, 1)


def _tier(p):
    return "critical" if p >= 0.75 else "high" if p >= 0.5 else "medium" if p >= 0.25 else "low"


def _fixed(x, digits):
    """Half away from zero on the shortest decimal, as the engine's formatter rounds."""
    return str(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _plain_facts(r):
    lines = [f"Account: {r['industry']}, {r['plan_tier']} plan, MRR ${r['mrr']:,.2f}, ARR ${r['mrr'] * 12:,.2f}, tenure "
             + (f"{r['tenure_days'] // 365}y " if r["tenure_days"] >= 365 else "") + f"{r['tenure_days'] % 365 // 30}mo, onboarding: "
             + ("yes (first 90 days)" if r["is_early_stage"] else "no"),
             f"Churn outlook: {_fixed(r['churn_probability'] * 100, 1)}% ({_tier(r['churn_probability']).upper()}), compliance and usage risk {_fixed(r['composite_risk'] * 100, 1)}%, "
             f"cohort rate {_fixed(r['cohort_rate'] * 100, 1)}%", f"Action: {r['action']}", "Signals:"]
    for feature, contribution in r["top_features"][:5]:
        v = r[feature]
        shown = v if feature in ("plan_tier", "industry") else _fixed(v, 0 if feature in BR.WHOLE_NUMBER_FEATURES else 2)
        lines.append(f"- {BR.FEATURE_LABELS.get(feature, feature)}: {'increases' if contribution > 0 else 'reduces'} churn risk (value {shown})")
    lines.append("Usage, last 30 days:")
    lines += [f"- {u['event_type']}: {u['n']}" for u in r["usage"] or []] or ["- none"]
    lines.append("Tickets, newest first:")
    lines += [f"- [{t['status'].upper()}] {t['topic']}, priority {t['priority']}, {(AS_OF - t['created_date']).days} days ago" for t in r["tickets"] or []] or ["- none"]
    o = r["opportunity"]
    return "\n".join(lines + [f"Opportunity: {o['stage']}, ${o['amount']:,.2f}" if o else "Opportunity: none"])


def test_facts_text_of_every_customer(spark, monkeypatch):
    """The query's own parts, with attributions that differ from row to row in place of the fitted model's."""
    from tidemark.plans import queries_models as QM
    from tidemark.plans import queries_text as QT
    names = QM.CHURN_X + ["plan_tier", "industry"]

    def attributed(s, d, which):
        struct = F.array(*[F.struct(F.lit(n).alias("feature"), (F.xxhash64("customer_id", F.lit(n)) / F.lit(2.0**63)).alias("contribution")) for n in names])
        return wh(s, d).churn_features.select("customer_id", F.array_sort(struct, lambda a, b: F.signum(F.abs(b["contribution"]) - F.abs(a["contribution"])).cast("int")).alias("top_features"))
    monkeypatch.setattr(QM, "_attr", attributed)
    rows = QT._facts_parts(spark, SF0001).withColumn("facts", BR.facts_text(lit_date(AS_OF))).withColumn("drivers", BR.driver_labels(F.col("top_features"))).collect()
    assert len(rows) == wh(spark, SF0001).churn_features.count() > 50
    seen = set()
    for row in rows:
        r = row.asDict(recursive=True)
        r["top_features"] = [(t["feature"], t["contribution"]) for t in r["top_features"]]
        assert r["facts"] == _plain_facts(r)
        assert r["drivers"] == [BR.FEATURE_LABELS.get(f, f) for f, _ in r["top_features"][:3]]
        seen |= {("usage", bool(r["usage"])), ("tickets", bool(r["tickets"])), ("opportunity", bool(r["opportunity"]))}
    assert ("opportunity", False) in seen and ("tickets", True) in seen


@pytest.fixture(scope="module")
def gated(spark):
    df = spark.createDataFrame([("a", 0.10, "growth", 0.0), ("b", 0.20, None, 10.0), ("c", 0.6, "enterprise", 1234567.0)],
                               "customer_id string, propensity double, target_tier string, expected_arr_uplift double")
    return {(r["customer_id"], r["audience"]): r for r in BR.gate(df).collect()}


def test_gate_texts_and_audience(gated):
    assert len(gated) == 6
    assert gated["a", "csm"]["gate"] == "rejected" and gated["a", "csm"]["summary"] is None
    b = gated["b", "executive"]
    assert b["summary"] == "Account not ready for outreach — propensity 20% is below the 35% threshold."
    assert b["brief"] == ("Account not ready for outreach. Propensity 20% (low) is below the activation threshold. Monitor for rising usage signals before "
                          "scheduling an upgrade conversation toward N/A.\n\n" + TX.WATERMARK)
    assert gated["c", "executive"]["summary"] == "This account has HIGH expansion propensity (60%) toward enterprise. Expected ARR uplift: $1,234,567."
    assert [k for k, r in gated.items() if r["wants_email"]] == [("c", "executive")]


def test_same_text_other_flags(spark):
    text = "Press immediately on sso_login_count and  magic_score_value. [EMAIL_DRAFT] Id 0f8fad5b-d9cb-469f-a165-70867728950e by XGBoost."
    df = spark.createDataFrame([(1, text, ["sso_login_count"], 0.3), (2, text, ["sso_login_count", "magic_score_value"], 0.7), (3, text, None, 0.3), (4, "", [], 0.3)],
                               "id int, raw_text string, own_features array<string>, propensity double")
    got = {r["id"]: r for r in BR.check_expansion_brief(df).collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["FLAGGED", "PASSED", "REJECTED", "PASSED"]
    assert [got[k]["confidence"] for k in (1, 2, 3, 4)] == [0.75, 1.0, 0.5, 1.0]
    assert got[1]["final_text"] == "Press on sso_login_count and magic_score_value.\n\n" + TX.WATERMARK
    assert got[2]["final_text"].startswith("Press immediately on sso_login_count and  magic")
    assert got[1]["email_draft"] == "Id [REDACTED] by [REDACTED]." and got[4]["email_draft"] is None
