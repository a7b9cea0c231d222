"""Survival analysis on day tables.

Every estimator first collapses customers to one row per (stratum, duration
day): that table is bounded by the number of distinct durations (a few
thousand days), not by the number of customers, so the ordered windows that
follow run over small data. Kaplan-Meier, log-rank and the hazard curve are
sums and products over that table.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions import stats as ST
from tidemark.functions.columns import lit_date
from tidemark.operators.cohort import pivot_rates

Z95 = 1.959963984540054


def r9(c: Column) -> Column:
    """Present floating results at 9 decimals (engines sum in different orders)."""
    return F.round(c.cast("decimal(38,12)"), 9).cast("double")


def surv_dataset(customers: DataFrame, as_of: _dt.date) -> DataFrame:
    """duration_days (churn or censoring at as_of) and event, duration > 0."""
    dur = F.datediff(F.coalesce(F.col("churn_date"), lit_date(as_of)), F.col("signup_date"))
    return customers.select("customer_id", "plan_tier", "industry", "signup_date", "churn_date", "upgrade_date",
                            "mrr", F.col("churn_date").isNotNull().cast("int").alias("event"),
                            dur.alias("duration_days")).where(F.col("duration_days") > 0)


def upgrade_dataset(customers: DataFrame, as_of: _dt.date) -> DataFrame:
    """Time to upgrade: churned-without-upgrade customers excluded."""
    c = customers.where(F.col("churn_date").isNull() | F.col("upgrade_date").isNotNull())
    return c.select("customer_id", "plan_tier", "industry",
                    F.datediff(F.coalesce("upgrade_date", lit_date(as_of)), F.col("signup_date")).alias("duration_days"),
                    F.col("upgrade_date").isNotNull().cast("int").alias("event"))


def km_curve(surv: DataFrame, stratum: Column | None = None) -> DataFrame:
    """Kaplan-Meier S(t) per stratum at each observed duration, with the
    log(-log) Greenwood 95 % interval."""
    stratum = stratum if stratum is not None else F.lit("all")
    day = surv.groupBy(stratum.cast("string").alias("stratum"), F.col("duration_days").alias("t")).agg(
        F.count(F.lit(1)).alias("removed"), F.sum("event").cast("long").alias("events"))
    rev = Window.partitionBy("stratum").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy("stratum").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("n_at_risk", F.sum("removed").over(rev))
    d, n = F.col("events"), F.col("n_at_risk")
    day = (day.withColumn("_log", F.sum(F.when(d < n, F.log(1 - d / n)).otherwise(0.0)).over(fwd))
              .withColumn("_zero", F.max(F.when((d == n) & (d > 0), 1).otherwise(0)).over(fwd))
              .withColumn("_cs", F.sum(F.when(n > d, d / (n * (n - d))).otherwise(0.0)).over(fwd)))
    s = F.when(F.col("_zero") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    day = day.withColumn("survival", s)
    v = F.log(F.col("survival"))
    ok = (F.col("survival") > 0) & (F.col("survival") < 1)
    lower = F.when(ok, F.exp(-F.exp(F.log(-v) + Z95 * F.sqrt("_cs") / v)))
    upper = F.when(ok, F.exp(-F.exp(F.log(-v) - Z95 * F.sqrt("_cs") / v)))
    return day.select("stratum", F.col("t").cast("long").alias("t"), F.col("n_at_risk").cast("long").alias("n_at_risk"),
                      "events", r9(F.col("survival")).alias("survival"), r9(lower).alias("ci_lower"),
                      r9(upper).alias("ci_upper"))


def km_median(curve: DataFrame) -> DataFrame:
    """First day with S <= 0.5 per stratum (NULL = not reached)."""
    return curve.groupBy("stratum").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_survival_days"))


def km_at(curve: DataFrame, days: tuple[int, ...] = (90, 180, 365)) -> DataFrame:
    """S(t) at fixed days: the value at the last observed time <= t (1.0 before any)."""
    aggs = [F.coalesce(F.max_by(F.when(F.col("t") <= t, F.col("survival")),
                                F.when(F.col("t") <= t, F.col("t"))), F.lit(1.0)).alias(f"s_{t}") for t in days]
    return curve.groupBy("stratum").agg(*aggs)


def logrank_two(surv: DataFrame, group1: Column, name: str = "logrank") -> DataFrame:
    """Two-group log-rank: O, E, V from a pooled day table; chi2 with 1 df."""
    day = surv.groupBy(F.col("duration_days").alias("t")).agg(
        F.count(F.lit(1)).alias("r"), F.count_if(group1).alias("r1"),
        F.sum("event").alias("d"), F.sum(F.when(group1, F.col("event")).otherwise(0)).alias("d1"))
    # single ordered window over the day table (bounded by distinct days, not rows)
    rev = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("n", F.sum("r").over(rev)).withColumn("n1", F.sum("r1").over(rev))
    n, n1, d = F.col("n").cast("double"), F.col("n1").cast("double"), F.col("d").cast("double")
    e1 = d * n1 / n
    v1 = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    agg = day.agg(F.sum("d1").cast("double").alias("observed"), F.sum(e1).alias("expected"), F.sum(v1).alias("variance"))
    chi2 = (F.col("observed") - F.col("expected")) ** 2 / F.col("variance")
    out = agg.select(F.lit(name).alias("test"), r9(F.col("observed")).alias("observed"),
                     r9(F.col("expected")).alias("expected"), r9(F.col("variance")).alias("variance"),
                     r9(chi2).alias("chi2"), F.lit(1).cast("long").alias("df"))
    return out


def with_chi2_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", ST.chi2_sf_udf(F.col("chi2"), F.col("df").cast("double")))


def logrank_k(surv: DataFrame, stratum: str, levels: list[str]) -> DataFrame:
    """k-group log-rank: O-E vector and covariance from one pass over a day
    table pivoted by group, solved as a (k-1)x(k-1) system in a pandas UDF
    over the single summary row."""
    import numpy as np
    import pandas as pd
    k = len(levels)
    day = surv.groupBy(F.col("duration_days").alias("t")).pivot(stratum, levels).agg(
        F.count(F.lit(1)).alias("r"), F.sum("event").alias("d")).na.fill(0)
    rev = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for g in levels:
        day = day.withColumn(f"n_{g}", F.sum(f"{g}_r").over(rev))
    n = sum((F.col(f"n_{g}") for g in levels), F.lit(0)).cast("double")
    d = sum((F.col(f"{g}_d") for g in levels), F.lit(0)).cast("double")
    aggs = []
    for i, g in enumerate(levels):
        aggs.append(F.sum(F.col(f"{g}_d")).cast("double").alias(f"o{i}"))
        aggs.append(F.sum(d * F.col(f"n_{g}") / n).alias(f"e{i}"))
        for j, h in enumerate(levels):
            if j < i:
                continue
            ni, nj = F.col(f"n_{g}").cast("double"), F.col(f"n_{h}").cast("double")
            cov = (d * (ni / n) * ((1.0 if i == j else 0.0) - nj / n) * (n - d) / (n - 1))
            aggs.append(F.sum(F.when(n > 1, cov).otherwise(0.0)).alias(f"v{i}_{j}"))
    summary = day.agg(*aggs)

    def solve(batches):
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                oe = np.array([r[f"o{i}"] - r[f"e{i}"] for i in range(k)])
                V = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        V[i, j] = V[j, i] = r[f"v{i}_{j}"]
                x = oe[:-1]
                chi2 = float(x @ np.linalg.solve(V[:-1, :-1], x))
                rows.append({"test": f"logrank_{stratum}", "groups": k, "chi2": chi2, "df": k - 1})
            yield pd.DataFrame(rows)

    out = summary.mapInPandas(solve, "test string, groups long, chi2 double, df long")
    return with_chi2_p(out)


def dropout_90d(surv: DataFrame) -> DataFrame:
    churned90 = (F.col("event") == 1) & (F.col("duration_days") <= 90)
    g = surv.groupBy("plan_tier", "industry").agg(F.count(F.lit(1)).alias("n"),
                                                  F.count_if(churned90).alias("churned_90d"))
    return g.withColumn("dropout_rate", F.round((F.col("churned_90d") / F.col("n")).cast("decimal(38,10)"), 6)
                        .cast("double"))


def dropout_90d_pivot(surv: DataFrame) -> DataFrame:
    """90-day dropout rate, a row per industry and a column per plan tier."""
    return pivot_rates(dropout_90d(surv), "industry", "plan_tier", "dropout_rate", K.PLAN_TIERS)


def hazard_curve(surv: DataFrame, max_day: int | None = None, sigma: float = 7.0, truncate: float = 4.0) -> DataFrame:
    """Daily hazard (churns / at risk) over all observed days, smoothed with a
    Gaussian kernel (reflected edges).

    The curve ends at the longest observed duration; with ``max_day`` later days
    fall into that last day. The tables here hold a row per day. The smoothing
    sends each day's hazard, weighted, to the days within the kernel's reach.
    """
    spark = surv.sparkSession
    if max_day is None:
        max_day = max(1, surv.agg(F.max("duration_days")).first()[0] or 1)
    days = spark.range(1, max_day + 1).select(F.col("id").cast("int").alias("day"))
    per_day = surv.groupBy(F.least(F.col("duration_days"), F.lit(max_day + 1)).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    churn = surv.where(F.col("event") == 1).groupBy(
        F.least(F.greatest(F.col("duration_days"), F.lit(1)), F.lit(max_day)).alias("day")).agg(F.count(F.lit(1)).alias("churns"))
    back = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at_risk = spark.range(1, max_day + 2).select(F.col("id").cast("int").alias("day")).join(per_day, "day", "left").select(
        "day", F.sum(F.coalesce("c", F.lit(0))).over(back).alias("at_risk"))
    h = days.join(churn, "day", "left").join(at_risk, "day", "left").select(
        "day", F.coalesce("churns", F.lit(0)).alias("churns"), F.greatest(F.coalesce("at_risk", F.lit(0)), F.lit(1)).alias("at_risk"))
    h = h.withColumn("raw_hazard", F.col("churns") / F.col("at_risk"))
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(k - radius).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in enumerate(weights)])
    base = h.select("day", "raw_hazard")
    before = base.where(F.col("day") <= radius).select((1 - F.col("day")).alias("day"), "raw_hazard")
    after = base.where(F.col("day") > max_day - radius).select((2 * max_day + 1 - F.col("day")).alias("day"), "raw_hazard")
    sent = base.unionByName(before).unionByName(after).select("day", "raw_hazard", F.explode(kernel).alias("x"))
    smooth = sent.groupBy((F.col("day") - F.col("x.k")).alias("day")).agg(F.sum(F.col("raw_hazard") * F.col("x.w")).alias("smoothed_hazard"))
    return h.join(smooth, "day").select(
        F.col("day").cast("long").alias("day"), F.col("churns").cast("long").alias("churns"), F.col("at_risk").cast("long").alias("at_risk"),
        r9(F.col("raw_hazard")).alias("raw_hazard"), r9(F.col("smoothed_hazard")).alias("smoothed_hazard"))


def hazard_peak(curve: DataFrame) -> DataFrame:
    return curve.agg(F.max_by("day", F.struct("smoothed_hazard", -F.col("day"))).alias("peak_day"),
                     F.max("smoothed_hazard").alias("peak_hazard"))
