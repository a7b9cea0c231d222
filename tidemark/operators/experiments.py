"""Intervention experiment read-out on real outcomes.

Eligibility and assignment are computed at an ``assignment_date``; outcomes
are observed over the next 90 days. Stratified 50/50 assignment is exact:
rows are numbered in (stratum, seeded hash) order by the distributed global
numbering, and the within-stratum index decides the arm, so no stratum is
sorted inside one task.
"""

from __future__ import annotations

import datetime as _dt
import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import betas
from tidemark.functions import constants as K
from tidemark.functions import stats as ST
from tidemark.functions.columns import lit_date
from tidemark.operators import ranking
from tidemark.operators.lookups import seeded_hash

# fixed values: prior, priors for the sensitivity check, decision thresholds
PRIOR = (2, 8)
PRIORS = [(1, 4, "weak"), (2, 8, "base"), (3, 7, "moderate"), (5, 15, "informative")]
INTERVAL = (0.025, 0.975)
EFFECTIVE, EXTEND, HARM, EARLY_STOP, EARLY_MIN_N = 0.90, 0.70, 0.10, 0.95, 40


def eligibility(customers: DataFrame, tickets: DataFrame, assignment_date: _dt.date) -> DataFrame:
    """Active at the assignment date, tenure in [14, 90] days, no open escalation
    (open high/critical ticket created before the assignment date)."""
    a = lit_date(assignment_date)
    tenure = F.datediff(a, F.col("signup_date"))
    base = customers.where((F.col("signup_date") <= a) & (F.col("churn_date").isNull() | (F.col("churn_date") > a))
                           & (tenure >= 14) & (tenure <= 90))
    esc = tickets.where(F.col("priority").isin(*K.HIGH_PRIORITIES) & F.col("resolution_time").isNull()
                        & (F.col("created_date") <= a)).select("customer_id")
    return base.join(esc, "customer_id", "left_anti")


def assign(eligible: DataFrame, salt: str = "exp-1", seed: int = K.RANDOM_SEED) -> DataFrame:
    h = seeded_hash("customer_id", f"{salt}-{seed}")
    pos = ranking.global_positions(eligible.withColumn("_h", h), [F.col("plan_tier"), F.col("_h"), F.col("customer_id")])
    first = pos.groupBy("plan_tier").agg(F.min("pos").alias("_first"))  # one row per stratum
    j = pos.join(F.broadcast(first), "plan_tier")
    idx = F.col("pos") - F.col("_first")
    return j.select("customer_id", "plan_tier", "signup_date", "churn_date",
                    F.when(idx % 2 == 0, "treatment").otherwise("control").alias("arm")).drop("_h")


def outcomes(assigned: DataFrame, assignment_date: _dt.date, window_days: int = 90) -> DataFrame:
    a = lit_date(assignment_date)
    churned = F.col("churn_date").isNotNull() & (F.col("churn_date") > a) & \
        (F.col("churn_date") <= F.date_add(a, window_days))
    return assigned.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(churned).alias("churned_90d"))


def secondary(assigned: DataFrame, events: DataFrame, tickets: DataFrame, assignment_date: _dt.date) -> DataFrame:
    """Per arm: share with an integration within 30 days, mean adoption over 60 days,
    tickets per customer within 30 days (each child table pre-aggregated per customer)."""
    a = lit_date(assignment_date)
    d = F.to_date("timestamp")
    ev = events.where((d >= a) & (d < F.date_add(a, 60))).groupBy("customer_id").agg(
        F.count_if((F.col("event_type") == "integration_connect") & (d < F.date_add(a, 30))).alias("integr_30d"),
        F.avg("feature_adoption_score").alias("adoption_60d"))
    tk = tickets.where((F.col("created_date") >= a) & (F.col("created_date") < F.date_add(a, 30))) \
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("tickets_30d"))
    j = assigned.select("customer_id", "arm").join(ev, "customer_id", "left").join(tk, "customer_id", "left")
    r = lambda c: F.round(c.cast("decimal(38,12)"), 9).cast("double")
    return j.groupBy("arm").agg(
        r(F.avg((F.coalesce("integr_30d", F.lit(0)) > 0).cast("int"))).alias("integration_rate_30d"),
        r(F.avg("adoption_60d")).alias("adoption_60d"),
        r(F.avg(F.coalesce("tickets_30d", F.lit(0)))).alias("tickets_per_customer_30d"))


def posterior(outcome: DataFrame, priors: list[tuple[int, int, str]] | None = None) -> DataFrame:
    """Beta-Binomial posterior per prior: P(treatment churn < control churn), mean,
    standard deviation and 95 % interval of the effect (control - treatment). Runs
    on the two-row outcome table by quadrature on fixed nodes: the work is per
    prior, whatever the counts."""
    priors = priors or [(PRIOR[0], PRIOR[1], "base")]
    pivot = outcome.groupBy().pivot("arm", ["treatment", "control"]).agg(
        F.first("n").alias("n"), F.first("churned_90d").alias("c"))

    def run(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                nt, ct, nc, cc = int(r["treatment_n"]), int(r["treatment_c"]), int(r["control_n"]), int(r["control_c"])
                for a0, b0, label in priors:
                    treated, control = betas.Beta(a0 + ct, b0 + nt - ct), betas.Beta(a0 + cc, b0 + nc - cc)
                    p_win = 1 - betas.probability_below(treated, control, 0.0)
                    low, high = (betas.difference_quantile(treated, control, q) for q in INTERVAL)
                    out.append({"prior": label, "prior_a": a0, "prior_b": b0, "n_treatment": nt, "churn_treatment": ct,
                                "n_control": nc, "churn_control": cc, "p_treatment_better": round(p_win, 9),
                                "p_harm": round(1 - p_win, 9), "effect_mean": round(control.mean - treated.mean, 6),
                                "effect_sd": round(math.hypot(treated.sd, control.sd), 6),
                                "effect_low_95": round(low, 6), "effect_high_95": round(high, 6)})
            yield pd.DataFrame(out)

    schema = ("prior string, prior_a long, prior_b long, n_treatment long, churn_treatment long, n_control long, "
              "churn_control long, p_treatment_better double, p_harm double, effect_mean double, effect_sd double, "
              "effect_low_95 double, effect_high_95 double")
    return pivot.na.fill(0).mapInPandas(run, schema)


def decision(post: DataFrame) -> DataFrame:
    p = F.col("p_treatment_better")
    d = (F.when(F.col("p_harm") > HARM, "stop").when(p >= EFFECTIVE, "effective").when(p >= EXTEND, "extend")
          .otherwise("redesign"))
    early = (p > EARLY_STOP) & (F.least("n_treatment", "n_control") >= EARLY_MIN_N)
    return post.select("prior", "p_treatment_better", "p_harm", d.alias("decision"), early.alias("early_stop_success"))


def required_n(baseline_rate: Column, mde: float = 0.10, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Per-arm n for a one-tailed two-proportion z-test."""
    z_a, z_b = NormalDist().inv_cdf(1 - alpha), NormalDist().inv_cdf(power)
    pc, pt = baseline_rate, baseline_rate - mde
    pbar = (pc + pt) / 2
    num = F.pow(z_a * F.sqrt(2 * pbar * (1 - pbar)) + z_b * F.sqrt(pc * (1 - pc) + pt * (1 - pt)), 2)
    return F.ceil(num / F.pow(pc - pt, 2)).cast("long")


def power_at_n(baseline_rate: Column, n: int, mde: float = 0.10, alpha: float = 0.05) -> Column:
    """Power of the one-tailed two-proportion z-test with ``n`` customers an arm."""
    pt = baseline_rate - mde
    se = F.sqrt((baseline_rate * (1 - baseline_rate) + pt * (1 - pt)) / n)
    return ST.norm_sf_udf(NormalDist().inv_cdf(1 - alpha) - mde / se)


def power_by_segment(customers: DataFrame, as_of: _dt.date, sizes: tuple[int, ...] = (50, 100, 200, 400), mde: float = 0.10) -> DataFrame:
    """Power per plan tier and arm size, for tiers whose 90-day churn exceeds ``mde``."""
    rates = required_n_by_segment(customers, as_of, mde).where(F.col("baseline_churn_90d") > mde)
    return rates.select("plan_tier", F.explode(F.array(*[
        F.struct(F.lit(n).cast("long").alias("n_per_arm"), power_at_n(F.col("baseline_churn_90d"), n, mde).alias("p")) for n in sizes])).alias("x")) \
        .select("plan_tier", "x.n_per_arm", F.round("x.p", 6).alias("power"))


def required_n_by_segment(customers: DataFrame, as_of: _dt.date, mde: float = 0.10) -> DataFrame:
    """Baseline 90-day churn rate per plan tier -> required n per arm."""
    dur = F.datediff(F.coalesce("churn_date", lit_date(as_of)), F.col("signup_date"))
    g = customers.groupBy("plan_tier").agg(
        F.avg((F.col("churn_date").isNotNull() & (dur <= 90)).cast("int")).alias("baseline_churn_90d"),
        F.count(F.lit(1)).alias("n_customers"))
    rate = F.col("baseline_churn_90d")
    return g.select("plan_tier", "n_customers", F.round(rate.cast("decimal(38,12)"), 6).cast("double")
                    .alias("baseline_churn_90d"),
                    F.when(rate > mde, required_n(rate, mde)).alias("required_n_per_arm"))


def outreach_lift(outreach: DataFrame) -> DataFrame:
    """Conversion by channel and propensity band from the outreach log."""
    band = (F.when(F.col("propensity_at_outreach") >= F.lit(0.65).cast("float"), "high")
             .when(F.col("propensity_at_outreach") >= F.lit(0.35).cast("float"), "medium").otherwise("low"))
    return outreach.groupBy("outreach_channel", band.alias("propensity_band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "upgraded").alias("converted"),
        F.round((F.count_if(F.col("outcome") == "upgraded") / F.count(F.lit(1))).cast("decimal(38,12)"), 6)
        .cast("double").alias("conversion_rate"))
