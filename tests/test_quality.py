"""Contracts on tables that break every rule, and the plan of the report."""

import datetime as dt

from tidemark.operators import features as FT
from tidemark.operators import quality as Q


def _tables(spark):
    d, t = dt.date, dt.datetime
    customers = [("1", "A", "free", d(2000, 1, 1), 0.0, None), ("2", "A", "starter", d(2000, 1, 1), 0.0, d(2000, 1, 1)), ("2", None, "growth", d(2000, 6, 1), -5.0, None),
                 (None, "B", "odd", None, 3.0, None), ("3", "B", "free", d(2000, 3, 1), 7.0, d(2000, 5, 1))]
    events = [("e1", "1", t(1999, 12, 31), "login", 0.5), ("e1", "3", t(2000, 5, 1), "login", 1.5), ("e2", "3", t(2000, 5, 1, 0, 0, 1), "strange", None),
              (None, "9", t(2000, 5, 2), "login", 0.1), ("e3", None, None, None, 0.1), ("e4", "3", t(2000, 6, 1), "login", 0.1)] + [(f"h{k}", "1", t(2000, 2, 1, 5), "login", 0.2) for k in range(500)]
    tickets = [("t1", "1", d(2000, 1, 5), "high", "billing", 0), ("t2", "9", d(2000, 1, 5), None, "odd", 5)]
    opps = [("o1", "1", "prospecting", d(2000, 1, 1), -1.0, "x"), ("o1", "8", None, None, 1.0, None)]
    risk = [("1", 0.5, 1), ("1", 1.5, -1), (None, None, None)]
    outreach = [("x1", "7", d(2000, 1, 1), 0.5, "email", "odd"), ("x2", "1", None, 2.0, None, None)]
    return {"customers": spark.createDataFrame(customers, "customer_id string, industry string, plan_tier string, signup_date date, mrr double, churn_date date"),
            "usage_events": spark.createDataFrame(events, "event_id string, customer_id string, timestamp timestamp, event_type string, feature_adoption_score double"),
            "support_tickets": spark.createDataFrame(tickets, "ticket_id string, customer_id string, created_date date, priority string, topic string, resolution_time int"),
            "gtm_opportunities": spark.createDataFrame(opps, "opp_id string, customer_id string, stage string, close_date date, amount double, sales_owner string"),
            "risk_signals": spark.createDataFrame(risk, "customer_id string, compliance_gap_score double, vendor_risk_flags int"),
            "expansion_outreach_log": spark.createDataFrame(
                outreach, "outreach_id string, customer_id string, contacted_date date, propensity_at_outreach double, outreach_channel string, outcome string")}


def _plain(tables):
    rows = {t: [r.asDict() for r in df.collect()] for t, df in tables.items()}
    out = {}
    for t, spec in Q.RAW_CONTRACTS.items():
        for c in spec["not_null"]:
            out["not_null", t, c] = sum(r[c] is None for r in rows[t])
        for c, values in spec["accepted"].items():
            out["accepted_values", t, c] = sum(r[c] is not None and r[c] not in values for r in rows[t])
        keys = [r[spec["unique"]] for r in rows[t] if r[spec["unique"]] is not None]
        out["unique", t, spec["unique"]] = len(keys) - len(set(keys))
    for t, c, lo, hi in Q.RANGE_CHECKS:
        out["range", t, c] = sum(r[c] is not None and (lo is not None and r[c] < lo or hi is not None and r[c] > hi) for r in rows[t])
    ids = {r["customer_id"] for r in rows["customers"]} - {None}
    for t in Q.CHILD_TABLES:
        out["foreign_key", t, "customer_id"] = sum(r["customer_id"] not in ids for r in rows[t])
    pairs = [(e["timestamp"], c) for e in rows["usage_events"] for c in rows["customers"] if e["timestamp"] and e["customer_id"] and e["customer_id"] == c["customer_id"]]
    midnight = dt.time()
    out["temporal_event_after_signup", "usage_events", "timestamp"] = sum(ts < dt.datetime.combine(c["signup_date"], midnight) for ts, c in pairs)
    out["temporal_event_before_churn", "usage_events", "timestamp"] = sum(c["churn_date"] is not None and ts > dt.datetime.combine(c["churn_date"], midnight) for ts, c in pairs)
    out["row_count_one_per_customer", "risk_signals", "customer_id"] = abs(len(rows["customers"]) - len(rows["risk_signals"]))
    out["conditional_free_mrr_zero", "customers", "mrr"] = 1
    out["conditional_paid_mrr_positive", "customers", "mrr"] = 2
    out["conditional_mrr_non_negative", "customers", "mrr"] = 1
    out["temporal_churn_after_signup", "customers", "churn_date"] = 1
    out["range", "support_tickets", "resolution_time"] = 1
    out["spread_signup_days", "customers", "signup_date"] = 548 - 152
    return out


def test_contracts_against_plain_counts(spark):
    tables = _tables(spark)
    report = Q.contract_report(tables, FT.event_days(tables["usage_events"], "timestamp")).collect()
    got = {(r["check"], r["table_name"], r["column_name"]): r["n_bad"] for r in report}
    assert len(got) == len(report) and got == _plain(tables)
    assert all(r["passed"] == (r["n_bad"] == 0) for r in report)


def test_one_scan_a_table_and_one_exchange(spark):
    from tests.conftest import SF0001
    from tidemark.plans.catalog import wh
    w = wh(spark, SF0001)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = Q.key_totals({t: getattr(w, t) for t in Q.RAW_CONTRACTS})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == len(Q.RAW_CONTRACTS) and plan.count("Exchange hashpartitioning") == 1


def test_row_counts(spark):
    tables = {"a": spark.range(5), "b": spark.range(5), "c": spark.range(2)}
    got = {(r["table_name"], r["rule"]): (r["expected"], r["n_rows"], r["passed"]) for r in Q.row_counts(tables, {"a": 5, "b": "c"}, {"c": 3, "b": "a"}).collect()}
    assert got == {("a", "exact"): (5, 5, True), ("b", "exact"): (2, 5, False), ("c", "minimum"): (3, 2, False), ("b", "minimum"): (5, 5, True)}
