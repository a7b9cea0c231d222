"""Cox proportional hazards (Efron ties, ridge penalty) by Newton-Raphson.

Each Newton step is ONE aggregation over the customer table grouped by
duration day: sums of r = exp(x b), r x and r x x^T over everyone and over
the events of that day. Risk-set sums are reverse running sums over that day
table (bounded by the number of distinct durations), the Efron terms are
closed expressions of a day's sums, whose work does not depend on how many churn
that day, and the driver solves the p x p Newton system. Covariates are centred and scaled
internally; the penalty 0.5 * lambda * ||b||^2 is applied to the mean
log-likelihood on that scale, and coefficients are reported on the original
scale with hazard ratios and 95 % intervals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _day_table(x: DataFrame, cols: list[str], beta: np.ndarray) -> DataFrame:
    p = len(cols)
    eta = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
    r = F.exp(eta)
    ev = F.col("event").cast("double")
    aggs = [F.sum(r).alias("s0"), F.sum(ev).alias("d"), F.sum(ev * r).alias("e0")]
    for j in range(p):
        aggs += [F.sum(r * F.col(cols[j])).alias(f"s1_{j}"), F.sum(ev * r * F.col(cols[j])).alias(f"e1_{j}"),
                 F.sum(ev * F.col(cols[j])).alias(f"xd_{j}")]
        for k in range(j, p):
            aggs += [F.sum(r * F.col(cols[j]) * F.col(cols[k])).alias(f"s2_{j}_{k}"),
                     F.sum(ev * r * F.col(cols[j]) * F.col(cols[k])).alias(f"e2_{j}_{k}")]
    day = x.groupBy("duration_days").agg(*aggs)
    rev = Window.orderBy(F.col("duration_days").desc()).rowsBetween(Window.unboundedPreceding, 0)  # day table
    sums = [c for c in day.columns if c.startswith("s")]
    return day.select("duration_days", "d", "e0", *[c for c in day.columns if c.startswith(("e1", "e2", "xd"))],
                      *[F.sum(c).over(rev).alias("R" + c) for c in sums]).where(F.col("d") > 0)


#: Terms of an Efron sum that are added one by one; the rest is a series.
DIRECT = 12


def efron_powers(z: Column, d: Column) -> tuple[Column, Column]:
    """Sums of 1 / (z - l) and 1 / (z - l)^2 over l = 0 .. d - 1, for z >= d, in
    constant work: the last ``DIRECT`` terms one by one, the m others as differences
    of digamma and trigamma, psi(x1) - psi(x0) with x1 = z + 1 and x0 = x1 - m > DIRECT,
    by their asymptotic series (error below 1e-15 there)."""
    one = two = F.lit(0.0)
    for i in range(DIRECT):
        gap = F.when(F.lit(i) < d, z - (d - 1 - i))
        one, two = one + F.coalesce(1 / gap, F.lit(0.0)), two + F.coalesce(1 / (gap * gap), F.lit(0.0))
    m = d - DIRECT
    x1 = z + 1
    x0 = x1 - m

    def apart(power: int) -> Column:  # x0^-power - x1^-power
        return F.pow(x0, F.lit(-power)) - F.pow(x1, F.lit(-power))
    digamma = F.log1p(m / x0) + m / (2 * x0 * x1) + apart(2) / 12 - apart(4) / 120 + apart(6) / 252 - apart(8) / 240 + apart(10) / 132
    trigamma = m / (x0 * x1) + apart(2) / 2 + apart(3) / 6 - apart(5) / 30 + apart(7) / 42 - apart(9) / 30 + apart(11) * 5 / 66
    return one + F.when(m > 0, digamma).otherwise(0.0), two + F.when(m > 0, trigamma).otherwise(0.0)


def with_efron_sums(day: DataFrame, at_risk: str, churning: str, d: str) -> DataFrame:
    """With f = l / d and D = at_risk - f * churning, add the sums over l = 0 .. d - 1
    of 1/D (a), f/D (b), 1/D^2 (aa), f/D^2 (ab) and f^2/D^2 (bb). The two power sums are
    columns of their own, so that their long expressions are planned once."""
    r, e, n = F.col(at_risk), F.col(churning), F.col(d)
    day = day.withColumn("_z", F.greatest(n / e * r, n))  # those churning are at risk, so z >= d but for rounding
    one, two = efron_powers(F.col("_z"), n)
    day = day.withColumns({"_one": one, "_two": two})
    z, one, two, scale = F.col("_z"), F.col("_one"), F.col("_two"), n / e
    return day.withColumns({"a": scale * one, "b": (z * one - n) / e, "aa": scale * scale * two, "ab": scale * (z * two - one) / e,
                            "bb": (z * z * two - 2 * z * one + n) / (e * e)}).drop("_z", "_one", "_two")


def _efron_sums(day: DataFrame, p: int):
    """Gradient and Hessian of the Efron partial likelihood as one row.

    The l-th of a day's d churns (l from 0) has the denominator R - (l/d) E, where R
    and E are sums over those at risk and those churning; over l only five sums are
    needed."""
    day = with_efron_sums(day, "Rs0", "e0", "d")
    c = F.col
    aggs = []
    for j in range(p):
        aggs.append(F.sum(c(f"xd_{j}") - (c(f"Rs1_{j}") * c("a") - c(f"e1_{j}") * c("b"))).alias(f"g{j}"))
        for k in range(j, p):
            second = c(f"Rs2_{j}_{k}") * c("a") - c(f"e2_{j}_{k}") * c("b")
            square = (c(f"Rs1_{j}") * c(f"Rs1_{k}") * c("aa") - (c(f"Rs1_{j}") * c(f"e1_{k}") + c(f"e1_{j}") * c(f"Rs1_{k}")) * c("ab")
                      + c(f"e1_{j}") * c(f"e1_{k}") * c("bb"))
            aggs.append(F.sum(square - second).alias(f"h{j}_{k}"))
    return day.agg(*aggs).first()


def fit_cox(df: DataFrame, covariates: list[str], penalizer: float = 0.01, max_iter: int = 50,
            tol: float = 1e-9) -> DataFrame:
    """df: duration_days, event, covariates. Returns one row per covariate."""
    spark = df.sparkSession
    p = len(covariates)
    st = df.agg(F.count(F.lit(1)).alias("n"),
                *[x for c in covariates for x in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                                                  F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}"))]).first()
    n = st["n"]
    mean = np.array([st[f"m_{c}"] for c in covariates])
    std = np.array([st[f"s_{c}"] or 1.0 for c in covariates])
    cols = [f"z{j}" for j in range(p)]
    x = df.select("duration_days", F.col("event").cast("int").alias("event"),
                  *[((F.col(c).cast("double") - float(mean[j])) / float(std[j])).alias(cols[j])
                    for j, c in enumerate(covariates)]).checkpoint(eager=True)
    beta = np.zeros(p)
    H = np.eye(p)
    for _ in range(max_iter):
        day = _day_table(x, cols, beta)
        tot = _efron_sums(day, p)
        g = np.array([tot[f"g{j}"] for j in range(p)])
        H = np.array([[tot[f"h{min(j, k)}_{max(j, k)}"] for k in range(p)] for j in range(p)])
        # mean objective with ridge penalty
        gm = g / n - penalizer * beta
        Hm = H / n - penalizer * np.eye(p)
        step = np.linalg.solve(Hm, gm)
        beta = beta - step
        if np.max(np.abs(step)) < tol:
            break
    else:
        raise RuntimeError(f"Cox fit: not converged after {max_iter} Newton steps (last step {np.max(np.abs(step)):.2e})")
    cov = np.linalg.inv(-(H - n * penalizer * np.eye(p)))
    se_z = np.sqrt(np.diag(cov))
    coef = beta / std
    se = se_z / std
    rows = [(c, float(coef[j]), float(np.exp(coef[j])), float(se[j]), float(np.exp(coef[j] - Z95 * se[j])),
             float(np.exp(coef[j] + Z95 * se[j]))) for j, c in enumerate(covariates)]
    return spark.createDataFrame(rows, "covariate string, coef double, hazard_ratio double, se double, "
                                       "hr_lower_95 double, hr_upper_95 double")


def cox_frame(feats: DataFrame, surv: DataFrame, covariates: list[str], tiers: list[str]) -> DataFrame:
    """EDA features z-scored by the fitter + plan-tier dummies (first level dropped)."""
    j = surv.select("customer_id", "duration_days", "event", "plan_tier").join(
        feats.select("customer_id", *covariates), "customer_id")
    dummies = [F.when(F.col("plan_tier") == t, 1.0).otherwise(0.0).alias(f"tier_{t}") for t in tiers[1:]]
    return j.select("duration_days", "event", *covariates, *dummies)
