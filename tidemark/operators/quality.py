"""Data contracts as DataFrame jobs.

Each check yields rows ``(check, table_name, column_name, n_bad, passed)``.
``contract_report`` reads every raw table once. A row becomes tagged keys (its
customer, its own id, and one for each rule it breaks), the keys of all tables
are one union, and one aggregation by key, combined on the map side, answers
uniqueness, foreign keys, row rules and row counts together. Event days are
checked on the stored daily rollup, not on raw events.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date

# The declared contracts of the six raw tables.
RAW_CONTRACTS = {
    "customers": {
        "not_null": ["customer_id", "industry", "plan_tier", "signup_date", "mrr"],
        "unique": "customer_id",
        "accepted": {"plan_tier": ["free", "starter", "growth", "enterprise"]},
    },
    "usage_events": {
        "not_null": ["event_id", "customer_id", "timestamp", "event_type", "feature_adoption_score"],
        "unique": "event_id",
        "accepted": {"event_type": K.EVENT_TYPES},
    },
    "support_tickets": {
        "not_null": ["ticket_id", "customer_id", "created_date", "priority", "topic"],
        "unique": "ticket_id",
        "accepted": {"priority": K.PRIORITIES, "topic": K.TOPICS},
    },
    "gtm_opportunities": {
        "not_null": ["opp_id", "customer_id", "stage", "close_date", "amount", "sales_owner"],
        "unique": "opp_id",
        "accepted": {"stage": K.STAGES},
    },
    "risk_signals": {
        "not_null": ["customer_id", "compliance_gap_score", "vendor_risk_flags"],
        "unique": "customer_id",
        "accepted": {},
    },
    "expansion_outreach_log": {
        "not_null": ["outreach_id", "customer_id", "contacted_date", "propensity_at_outreach",
                     "outreach_channel"],
        "unique": "outreach_id",
        "accepted": {"outcome": K.OUTCOMES},
    },
}

# Value ranges (table, column, low, high; None = open side)
RANGE_CHECKS = [
    ("usage_events", "feature_adoption_score", 0.0, 1.0),
    ("risk_signals", "compliance_gap_score", 0.0, 1.0),
    ("risk_signals", "vendor_risk_flags", 0, None),
    ("gtm_opportunities", "amount", 0, None),
    ("expansion_outreach_log", "propensity_at_outreach", 0.0, 1.0),
]
CHILD_TABLES = ["usage_events", "support_tickets", "gtm_opportunities", "risk_signals",
                "expansion_outreach_log"]


def row_rules(table: str) -> list[tuple[str, str, Column]]:
    """(check, column, predicate of a bad row) of every rule on single rows."""
    spec = RAW_CONTRACTS[table]
    items: list[tuple[str, str, Column]] = []
    for c in spec["not_null"]:
        items.append(("not_null", c, F.col(c).isNull()))
    for c, values in spec["accepted"].items():
        items.append(("accepted_values", c, F.col(c).isNotNull() & ~F.col(c).isin(*values)))
    for t, c, lo, hi in RANGE_CHECKS:
        if t == table:
            bad = F.lit(False)
            if lo is not None:
                bad = bad | (F.col(c) < lo)
            if hi is not None:
                bad = bad | (F.col(c) > hi)
            items.append(("range", c, bad))
    if table == "support_tickets":
        items.append(("range", "resolution_time", F.col("resolution_time") <= 0))
    if table == "customers":
        mrr, plan = F.col("mrr"), F.col("plan_tier")
        items.append(("conditional_mrr_non_negative", "mrr", mrr < 0))
        items.append(("conditional_paid_mrr_positive", "mrr", (plan != "free") & (mrr <= 0)))
        items.append(("conditional_free_mrr_zero", "mrr", (plan == "free") & (mrr != 0)))
        items.append(("temporal_churn_after_signup", "churn_date",
                      F.col("churn_date").isNotNull() & (F.col("churn_date") <= F.col("signup_date"))))
    return items


# Kinds of tagged keys: a customer's id, a table's own id (OWN + table number),
# a broken rule (RULE + its number).
CUSTOMER, OWN, RULE = 0, 1, 100


def _tagged_keys(no: int, table: str, df: DataFrame, first_rule: int) -> DataFrame:
    """(kind, tag, key, day): a row's keys; rules cost a row only where they are broken."""
    def key(kind: int, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("key"))
    keys = [key(CUSTOMER, F.col("customer_id"))]
    own = RAW_CONTRACTS[table]["unique"]
    if own != "customer_id":
        keys.append(key(OWN + no, F.col(own)))
    rules = [F.coalesce(bad, F.lit(False)) for _, _, bad in row_rules(table)]
    broken = F.array(*[F.when(bad, key(RULE + first_rule + i, F.lit(None))) for i, bad in enumerate(rules)])
    any_broken = rules[0]
    for bad in rules[1:]:
        any_broken = any_broken | bad
    every = F.when(any_broken, F.concat(F.array(*keys), F.array_compact(broken))).otherwise(F.array(*keys))
    day = F.unix_date("signup_date") if table == "customers" else F.lit(None)
    return df.select(day.cast("int").alias("day"), F.explode(every).alias("x")).select("x.kind", F.lit(no).alias("tag"), "x.key", "day")


def key_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, n0, n1, ..., first_day, last_day): how often each tagged key occurs
    in each table. One scan a table, one exchange."""
    parts, first = [], 0
    for no, t in enumerate(RAW_CONTRACTS):
        parts.append(_tagged_keys(no, t, tables[t], first))
        first += len(row_rules(t))
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("kind", "key").agg(*[F.count_if(F.col("tag") == no).alias(f"n{no}") for no in range(len(RAW_CONTRACTS))],
                                            F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def kind_totals(keys: DataFrame) -> DataFrame:
    """A row per kind: for each table the rows (r), the repeats of a key (u) and the
    rows whose key is no customer's (f), and the days' range."""
    known, tables = F.col("key").isNotNull(), range(len(RAW_CONTRACTS))
    n = [F.col(f"n{no}") for no in tables]
    return keys.groupBy("kind").agg(
        *[F.sum(n[no]).alias(f"r{no}") for no in tables],
        *[F.sum(F.when(known & (n[no] > 0), n[no] - 1).otherwise(0)).alias(f"u{no}") for no in tables],
        *[F.sum(F.when(~known | (n[0] == 0), n[no]).otherwise(0)).alias(f"f{no}") for no in tables],
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def contract_report(tables: dict[str, DataFrame], event_days: DataFrame) -> DataFrame:
    """Every contract check of the raw tables, and that no event lies before its
    customer's signup or after the churn day's first instant."""
    checks, rule = [], 0  # (check, table, column, kind, figure)
    number = {t: no for no, t in enumerate(RAW_CONTRACTS)}
    for t, no in number.items():
        for check, column, _ in row_rules(t):
            checks.append((check, t, column, RULE + rule, f"r{no}"))
            rule += 1
        own = RAW_CONTRACTS[t]["unique"]
        checks.append(("unique", t, own, CUSTOMER if own == "customer_id" else OWN + no, f"u{no}"))
    checks += [("foreign_key", t, "customer_id", CUSTOMER, f"f{number[t]}") for t in CHILD_TABLES]
    checks.append(("spread_signup_days", "customers", "signup_date", CUSTOMER, "spread"))
    checks.append(("row_count_one_per_customer", "risk_signals", "customer_id", CUSTOMER, "count_gap"))
    totals = kind_totals(key_totals(tables))  # a row per kind, at most one a rule and table
    totals = totals.withColumn("spread", F.greatest(F.lit(0), 548 - (F.col("last_day") - F.col("first_day")))).withColumn(
        "count_gap", F.abs(F.col(f"r{number['customers']}") - F.col(f"r{number['risk_signals']}")))
    figures = sorted({c[4] for c in checks})
    long = totals.select("kind", F.expr(f"stack({len(figures)}, " + ", ".join(f"'{f}', CAST({f} AS BIGINT)" for f in figures) + ") AS (figure, n_bad)"))
    wanted = tables["customers"].sparkSession.createDataFrame(checks, "check string, table_name string, column_name string, kind int, figure string")
    report = wanted.join(long, ["kind", "figure"], "left").select(
        "check", "table_name", "column_name", F.when(F.col("figure") == "spread", F.col("n_bad")).otherwise(F.coalesce("n_bad", F.lit(0))).alias("n_bad"))
    return report.unionByName(temporal_event_checks(tables["customers"], event_days)).withColumn("passed", F.coalesce(F.col("n_bad") == 0, F.lit(False)))


def temporal_event_checks(customers: DataFrame, event_days: DataFrame) -> DataFrame:
    """Events before signup or after midnight of the churn day, from the daily rollup."""
    j = event_days.select("customer_id", "day", "n", "n_midnight").join(customers.select("customer_id", "signup_date", "churn_date"), "customer_id")
    late = F.when(F.col("day") > F.col("churn_date"), F.col("n")).when(F.col("day") == F.col("churn_date"), F.col("n") - F.col("n_midnight"))
    agg = j.agg(F.coalesce(F.sum(F.when(F.col("day") < F.col("signup_date"), F.col("n"))), F.lit(0)).alias("before"), F.coalesce(F.sum(late), F.lit(0)).alias("after"))
    return agg.select(F.expr("stack(2, 'temporal_event_after_signup', before, 'temporal_event_before_churn', after) AS (check, n_bad)")).select(
        "check", F.lit("usage_events").alias("table_name"), F.lit("timestamp").alias("column_name"), F.col("n_bad").cast("long").alias("n_bad"))


def row_counts(tables: dict[str, DataFrame], exact: dict[str, str | int], minimum: dict[str, str | int]) -> DataFrame:
    """(table_name, rule, expected, n_rows, passed): exact and minimum row counts. A
    count is expected as a number or as another table's name (as many rows as that).
    Counts come from the files' footers, in one row a table."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()]
    counts = reduce(DataFrame.unionByName, counted)
    spark = counts.sparkSession
    wanted = [(t, rule, None if isinstance(v, int) else v, v if isinstance(v, int) else None)
              for rule, spec in (("exact", exact), ("minimum", minimum)) for t, v in spec.items()]
    rules = spark.createDataFrame(wanted, "table_name string, rule string, other string, number long")
    others = counts.select(F.col("table_name").alias("other"), F.col("n_rows").alias("other_rows"))
    j = rules.join(counts, "table_name").join(others, "other", "left").withColumn("expected", F.coalesce("number", "other_rows"))
    ok = F.when(F.col("rule") == "exact", F.col("n_rows") == F.col("expected")).otherwise(F.col("n_rows") >= F.col("expected"))
    return j.select("table_name", "rule", "expected", "n_rows", ok.alias("passed"))


def rate_bands(customers: DataFrame, outreach: DataFrame) -> DataFrame:
    """Observed rates against the bands the original's data tests assert."""
    c = customers.agg(
        *[F.avg(F.when(F.col("plan_tier") == t, F.col("churn_date").isNotNull().cast("int")))
           .alias(f"churn_{t}") for t in ("starter", "growth", "enterprise")],
        F.avg(F.col("upgrade_date").isNotNull().cast("int")).alias("upgrade_rate"))
    o = outreach.agg(
        F.avg((F.col("propensity_at_outreach") > 0.65).cast("int")).alias("high_propensity_share"),
        F.avg((F.col("outcome") == "upgraded").cast("int")).alias("outreach_conversion"))
    # fixed values: (metric, low, high)
    bands = {"churn_starter": (0.35, 0.55), "churn_growth": (0.12, 0.28), "churn_enterprise": (0.04, 0.15),
             "upgrade_rate": (0.05, 0.25), "high_propensity_share": (0.50, 1.0),
             "outreach_conversion": (0.15, 0.40)}

    def unpivot(df: DataFrame) -> DataFrame:
        ms = [m for m in bands if m in df.columns]
        args = ", ".join(f"'{m}', CAST({m} AS DOUBLE), CAST({bands[m][0]} AS DOUBLE), "
                         f"CAST({bands[m][1]} AS DOUBLE)" for m in ms)
        return df.select(F.expr(f"stack({len(ms)}, {args}) AS (metric, value, low, high)"))

    out = unpivot(c).unionByName(unpivot(o))
    return out.select("metric", F.round(F.col("value").cast("decimal(38,10)"), 6).cast("double").alias("value"),
                      "low", "high", F.col("value").between(F.col("low"), F.col("high")).alias("passed"))


def freshness(df: DataFrame, loaded_at: str, as_of: _dt.date, warn_days: int = 7, error_days: int = 30) -> DataFrame:
    age = F.datediff(lit_date(as_of), F.to_date(F.max(loaded_at)))
    return df.agg(age.alias("age_days")).select(
        F.col("age_days").cast("long").alias("age_days"),
        F.when(F.col("age_days") > error_days, "error").when(F.col("age_days") > warn_days, "warn")
         .otherwise("pass").alias("status"))


def value_object_guard(scores: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, rejected-with-reason) by named predicates."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = scores.withColumn("reject_reason", reason)
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.where(F.col("reject_reason").isNotNull()))
