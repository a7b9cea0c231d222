"""Cohort and descriptive analyses over whole tables."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import stats as ST
from tidemark.functions.columns import lit_date
from tidemark.operators import ranking
from tidemark.operators.features import mean_score, n_if


def _pct(num: Column, den: Column, digits: int = 1) -> Column:
    return F.round((num * 100.0 / den).cast("decimal(38,10)"), digits).cast("double")


def _r(c: Column, digits: int) -> Column:
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def churn_by_tier(customers: DataFrame) -> DataFrame:
    return customers.groupBy("plan_tier").agg(
        F.count(F.lit(1)).alias("n_customers"), F.count("churn_date").alias("n_churned"),
        _pct(F.count("churn_date"), F.count(F.lit(1))).alias("churn_rate_pct"),
        _r(F.avg(F.col("mrr").cast("double")), 0).alias("avg_mrr_usd"))


def event_mix(events: DataFrame) -> DataFrame:
    """Count and share per event type; the total comes from the aggregated rows."""
    g = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))
    total = F.sum("n_events").over(Window.partitionBy())
    return g.select("event_type", "n_events", _pct(F.col("n_events"), total, 1).alias("pct"),
                    _pct(F.col("n_events"), total, 2).alias("pct_of_total"))


def survival_frame(customers: DataFrame, as_of: _dt.date) -> DataFrame:
    """(duration_days, is_churned) per customer; censored at as_of."""
    dur = F.when(F.col("churn_date").isNotNull(), F.datediff("churn_date", "signup_date")) \
           .otherwise(F.datediff(lit_date(as_of), F.col("signup_date")))
    return customers.select("customer_id", "plan_tier", "industry", "signup_date", "churn_date", "upgrade_date",
                            "mrr", F.col("churn_date").isNotNull().cast("int").alias("is_churned"),
                            dur.alias("duration_days"))


def cohort_retention(customers: DataFrame, as_of: _dt.date, months: int = 12) -> DataFrame:
    """Signup-month cohorts x M+00..M+12 retained %. One groupBy with 13
    conditional counts: no month table, no cross product."""
    s = survival_frame(customers, as_of)
    dm = F.floor(F.col("duration_days") / 30.44)
    aggs = [F.count(F.lit(1)).alias("cohort_size")]
    for m in range(months + 1):
        kept = F.count_if((F.col("is_churned") == 0) | (dm >= m))
        aggs.append(_pct(kept, F.count(F.lit(1))).alias(f"m_{m:02d}"))
    return s.groupBy(F.date_format("signup_date", "yyyy-MM").alias("cohort")).agg(*aggs)


def cohort_month3(retention: DataFrame) -> DataFrame:
    return retention.agg(
        _r(F.avg("m_03"), 6).alias("avg_m3_retention_pct"),
        F.min_by("cohort", F.struct("m_03", "cohort")).alias("worst_cohort"),
        F.min("m_03").alias("worst_m3_retention_pct"))


def cohort_tier_industry(customers: DataFrame) -> DataFrame:
    g = customers.groupBy("plan_tier", "industry").agg(
        F.count(F.lit(1)).alias("n_customers"), F.count("churn_date").alias("n_churned"))
    return g.withColumn("churn_rate", _r(F.col("n_churned") / F.col("n_customers"), 6))


#: Most columns a pivot may have; more values raise an error instead of a huge row.
MAX_PIVOT = 200


def pivot_rates(long: DataFrame, rows: str, column: str, value: str, declared: list[str]) -> DataFrame:
    """A row per ``rows``, a column per value of ``column``; missing cells are null.
    The values are found first, from the grouped table (at most ``MAX_PIVOT``, else an
    error): the declared ones in their order, then any others by name. With the
    values given, Spark pivots in one aggregation."""
    found = {r[0] for r in long.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_PIVOT + 1).collect()}
    names = declared + sorted(found - set(declared))
    if len(names) > MAX_PIVOT:
        raise ValueError(f"{column} has more than {MAX_PIVOT} values")
    return long.groupBy(rows).pivot(column, names).agg(F.first(value))


def cohort_tier_industry_pivot(customers: DataFrame) -> DataFrame:
    """Churn rate, a row per industry and a column per plan tier."""
    return pivot_rates(cohort_tier_industry(customers), "industry", "plan_tier", "churn_rate", K.PLAN_TIERS)


def tier_churn_ratio(customers: DataFrame) -> DataFrame:
    """Starter vs enterprise churn rate and their ratio (tier risk multiplier)."""
    a = customers.agg(
        F.avg(F.when(F.col("plan_tier") == "starter", F.col("churn_date").isNotNull().cast("int"))).alias("s"),
        F.avg(F.when(F.col("plan_tier") == "enterprise", F.col("churn_date").isNotNull().cast("int"))).alias("e"))
    return a.select(_r(F.col("s"), 6).alias("starter_churn_rate"), _r(F.col("e"), 6).alias("enterprise_churn_rate"),
                    _r(F.col("s") / F.col("e"), 6).alias("tier_risk_multiplier"))


EDA_FEATURES = ["events_last_30d", "avg_adoption_score", "retention_signal_count",
                "integration_connects_first_30d", "high_priority_tickets"]


def feat_eda_all(customers: DataFrame, days: DataFrame, tickets: DataFrame, as_of: _dt.date) -> DataFrame:
    """Five features for every customer from the daily rollup; events NOT cut at the reference date,
    retention counted over a different type set (as in the descriptive analysis)."""
    ref = F.coalesce(F.col("churn_date"), lit_date(as_of))
    refs = customers.select("customer_id", "plan_tier", "industry", "signup_date", "mrr",
                            F.col("churn_date").isNotNull().cast("int").alias("is_churned"), ref.alias("obs_date"))
    j = days.join(refs.select("customer_id", "signup_date", "obs_date"), "customer_id", "inner")
    ev = j.groupBy("customer_id").agg(
        n_if(F.col("day") >= F.date_sub("obs_date", 30)).alias("events_last_30d"),
        mean_score().alias("avg_adoption_score"),
        n_if(F.col("event_type").isin(*K.EDA_RETENTION_EVENT_TYPES)).alias("retention_signal_count"),
        n_if((F.col("event_type") == "integration_connect")
             & (F.col("day") <= F.date_add("signup_date", 30))).alias("integration_connects_first_30d"))
    tk = tickets.groupBy("customer_id").agg(
        F.count_if(F.col("priority").isin(*K.HIGH_PRIORITIES)).alias("high_priority_tickets"))
    out = refs.join(ev, "customer_id", "left").join(tk, "customer_id", "left")
    return out.select("customer_id", "plan_tier", "industry", "mrr", "is_churned",
                      *[F.coalesce(c, F.lit(0.0) if c == "avg_adoption_score" else F.lit(0)).alias(c)
                        for c in EDA_FEATURES])


def median_split(feats: DataFrame, features: list[str] = EDA_FEATURES) -> DataFrame:
    """Exact median of each feature for churned vs active (long format), from one
    unpivoted table of value counts."""
    args = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in features)
    long = feats.select("is_churned", F.expr(f"stack({len(features)}, {args}) AS (feature, value)"))
    return ranking.exact_quantiles(long, ["is_churned", "feature"], "value", [0.5]).select("is_churned", "feature", F.col("q0").alias("median"))


def point_biserial(feats: DataFrame, label: str = "is_churned", features: list[str] = EDA_FEATURES) -> DataFrame:
    """Pearson r of each feature with the 0/1 label, t statistic, rank by |r|.
    All correlations come from one aggregation pass."""
    g = feats.agg(F.count(F.lit(1)).alias("n"),
                  *[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    args = ", ".join(f"'{c}', {c}" for c in features)
    long = g.select("n", F.expr(f"stack({len(features)}, {args}) AS (feature, r)"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    w = Window.orderBy(F.abs(F.col("r")).desc(), F.col("feature"))  # over <= features rows
    return long.select("feature", "n", _r(F.col("r"), 6).alias("correlation"), _r(F.abs("r"), 6).alias("abs_corr"),
                       _r(t, 6).alias("t_stat"), F.row_number().over(w).cast("long").alias("rank"))


def point_biserial_p(feats: DataFrame) -> DataFrame:
    """The point-biserial table with its two-sided p-value (t distribution, n - 2 degrees)."""
    t = point_biserial(feats)
    return t.withColumn("p_value", ST.t_two_sided_udf(F.col("t_stat"), (F.col("n") - 2).cast("double")))


def pearson_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """All pairwise Pearson correlations in one aggregation (long format)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    g = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}")
                 for k, (a, b) in enumerate(pairs)])
    both = [(a, b, k) for k, (a, b) in enumerate(pairs)] + [(b, a, k) for k, (a, b) in enumerate(pairs) if a != b]
    args = ", ".join(f"'{a}', '{b}', c{k}" for a, b, k in both)
    return g.select(F.expr(f"stack({len(both)}, {args}) AS (feature_a, feature_b, r)")).select(
        "feature_a", "feature_b", _r(F.col("r"), 6).alias("r"))


def spearman_matrix(feats: DataFrame, features: list[str]) -> DataFrame:
    """Rank correlation: the value counts of all columns are prefix-summed in one
    pass, each row looks its ranks up, then Pearson."""
    args = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in features)
    long = feats.select("customer_id", F.expr(f"stack({len(features)}, {args}) AS (feature, value)"))
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    run = ranking.prefix_sums(counts, ["feature", "value"], ["n"])
    first = run.groupBy("feature").agg(F.min("n_before").alias("start"))  # a row per feature
    ranks = run.join(F.broadcast(first), "feature").select(
        "feature", "value", (F.col("n_before") - F.col("start") + (F.col("n") + 1) / 2.0).alias("rank"))
    wide = long.join(ranks, ["feature", "value"]).groupBy("customer_id").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in features])
    return pearson_matrix(wide, features)


def integration_buckets(feats: DataFrame) -> DataFrame:
    i = F.col("integration_connects_first_30d")
    b = F.when(i == 0, "0").when(i <= 2, "1–2").when(i <= 5, "3–5").otherwise("6+")
    g = feats.groupBy(b.alias("integration_bucket")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.sum("is_churned").cast("long").alias("n_churned"),
        F.sum(F.col("mrr").cast("double")).alias("_mrr"))
    all_w = Window.partitionBy()  # over the <= 4 aggregated rows
    rate = F.col("n_churned") / F.col("n_customers")
    g = g.withColumn("_rate", rate)
    r3 = F.avg(F.when(F.col("integration_bucket").isin("3–5", "6+"), F.col("_rate"))).over(all_w)
    return g.select("integration_bucket", "n_customers", "n_churned", _r(rate, 6).alias("churn_rate"),
                    _r(F.col("_rate") / r3, 6).alias("multiplier_vs_3plus"),
                    _r(F.col("n_churned") * 12 * F.sum("_mrr").over(all_w) / F.sum("n_customers").over(all_w), 0).alias("arr_at_risk"))


def upgrade_totals(customers: DataFrame) -> DataFrame:
    up, ch = F.col("upgrade_date").isNotNull(), F.col("churn_date").isNotNull()
    return customers.agg(
        F.count_if(up).alias("n_upgraded"), F.count_if(~up & ~ch).alias("n_active_not_upgraded"),
        F.count_if(ch).alias("n_churned"), F.count(F.lit(1)).alias("n_total"),
        _pct(F.count_if(up), F.count(F.lit(1))).alias("upgrade_rate_pct"))


def upgrades_by_month(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("upgrade_date").isNotNull()).groupBy(
        F.date_trunc("month", F.col("upgrade_date")).cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("upgrades"))


def opp_mix(opps: DataFrame) -> DataFrame:
    return opps.groupBy("opportunity_type").agg(F.count(F.lit(1)).alias("n"))


def upgrade_by_tier(customers: DataFrame) -> DataFrame:
    up = F.col("upgrade_date").isNotNull()
    return customers.groupBy("plan_tier").agg(
        F.count(F.lit(1)).alias("n_customers"), F.count_if(up).alias("n_upgraded"),
        _pct(F.count_if(up), F.count(F.lit(1))).alias("upgrade_rate_pct"))


def upgrade_by_usage_quartile(customers: DataFrame, events: DataFrame) -> DataFrame:
    """NTILE(4) over total events (ties broken by customer_id) -> upgrade rate.
    Positions come from the distributed global numbering, not a global window."""
    counts = events.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_events"))
    c = customers.select("customer_id", "upgrade_date").join(counts, "customer_id", "left") \
        .withColumn("total_events", F.coalesce("total_events", F.lit(0)))
    pos = ranking.global_positions(c, [F.col("total_events"), F.col("customer_id")])
    n = pos.count()  # one number to the driver
    q = pos.withColumn("usage_quartile", ranking.ntile_from_position(F.col("pos"), F.lit(n), 4))
    up = F.col("upgrade_date").isNotNull()
    return q.groupBy("usage_quartile").agg(
        F.count(F.lit(1)).alias("n"), _pct(F.count_if(up), F.count(F.lit(1))).alias("upgrade_rate_pct"))


def cohort_churn_rate_context(customers: DataFrame) -> DataFrame:
    """Churn rate of each customer's tier x industry cohort (cohort table has
    a row per tier and industry; industry is an open text, so AQE decides by its size)."""
    g = customers.groupBy("plan_tier", "industry").agg(
        F.avg(F.col("churn_date").isNotNull().cast("int")).alias("_r"))
    return customers.select("customer_id", "plan_tier", "industry").join(g, ["plan_tier", "industry"]) \
        .select("customer_id", "plan_tier", "industry", _r(F.col("_r"), 6).alias("cohort_churn_rate"))
