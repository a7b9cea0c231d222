"""Cohort, descriptive, point-in-time and (later) survival/drift/stat queries."""

from __future__ import annotations

from tidemark.functions import constants as K
from tidemark.operators import cohort as CO
from tidemark.operators import features as FT
from tidemark.plans import oracle_analysis as OA
from tidemark.plans.catalog import register, wh
from tidemark.plans.oracle_base import with_ctes
from tidemark.sources.adapter import event_stream_as_usage


def _a(name: str, extra_sql: str | None = None) -> str:
    return with_ctes(extra_sql or OA.ANALYSIS[name], OA.ANALYSIS_CTES)


def _eda(s, d):
    w = wh(s, d)
    return w.eda_features


register("eda_churn_by_tier", _a("eda_churn_by_tier"))(lambda s, d: CO.churn_by_tier(wh(s, d).customers))
register("eda_event_mix", _a("eda_event_mix"))(lambda s, d: CO.event_mix(wh(s, d).usage_events))
register("events_event_mix", _a("events_event_mix"))(lambda s, d: CO.event_mix(event_stream_as_usage(s, d)))
register("cohort_retention", _a("cohort_retention"))(
    lambda s, d: CO.cohort_retention(wh(s, d).customers, K.ORDERS_AS_OF))
register("cohort_month3", _a("cohort_month3"))(
    lambda s, d: CO.cohort_month3(CO.cohort_retention(wh(s, d).customers, K.ORDERS_AS_OF)))
register("cohort_tier_industry", _a("cohort_tier_industry"))(lambda s, d: CO.cohort_tier_industry(wh(s, d).customers))
register("cohort_tier_industry_pivot", _a("cohort_tier_industry_pivot"))(lambda s, d: CO.cohort_tier_industry_pivot(wh(s, d).customers))
register("cohort_tier_ratio", _a("cohort_tier_ratio"))(lambda s, d: CO.tier_churn_ratio(wh(s, d).customers))
register("feat_eda_all", _a("feat_eda_all"))(_eda)
register("eda_median_split", _a("eda_median_split"))(lambda s, d: CO.median_split(_eda(s, d)))
register("eda_point_biserial", _a("eda_point_biserial"))(lambda s, d: CO.point_biserial(_eda(s, d)))
register("eda_point_biserial_p")(lambda s, d: CO.point_biserial_p(_eda(s, d)))
register("eda_spearman_matrix", _a("eda_spearman_matrix"))(
    lambda s, d: CO.spearman_matrix(_eda(s, d), CO.EDA_FEATURES + ["is_churned"]))
register("eda_integration_bucket", _a("eda_integration_bucket"))(lambda s, d: CO.integration_buckets(_eda(s, d)))
register("eda_upgrade_totals", _a("eda_upgrade_totals"))(lambda s, d: CO.upgrade_totals(wh(s, d).customers))
register("eda_upgrades_by_month", _a("eda_upgrades_by_month"))(lambda s, d: CO.upgrades_by_month(wh(s, d).customers))
register("eda_opp_mix", _a("eda_opp_mix"))(lambda s, d: CO.opp_mix(wh(s, d).gtm_opportunities))
register("eda_upgrade_by_tier", _a("eda_upgrade_by_tier"))(lambda s, d: CO.upgrade_by_tier(wh(s, d).customers))
register("eda_upgrade_by_usage_quartile", _a("eda_upgrade_by_usage_quartile"))(
    lambda s, d: CO.upgrade_by_usage_quartile(wh(s, d).customers, wh(s, d).usage_events))
register("ctx_cohort_churn_rate", _a("ctx_cohort_churn_rate"))(
    lambda s, d: CO.cohort_churn_rate_context(wh(s, d).customers))


def _events_stg(s, d):
    return wh(s, d).stg_usage_events()


def train_churn(s, d):
    return wh(s, d).train_churn_pit


def train_expansion(s, d):
    return wh(s, d).train_expansion_pit


register("train_churn_pit", _a("train_churn_pit"))(train_churn)
register("train_expansion_pit", _a("train_expansion_pit"))(train_expansion)

EXP_CORR_FEATURES = K.EXPANSION_NUMERIC_FEATURES + ["label"]
register("eda_pearson_matrix", with_ctes(
    OA.pearson_sql("xpit", EXP_CORR_FEATURES),
    OA.ANALYSIS_CTES + ",\nxpit AS (" + OA.ANALYSIS["train_expansion_pit"] + ")"))(
    lambda s, d: CO.pearson_matrix(train_expansion(s, d), EXP_CORR_FEATURES))

# ------------------------------------------------------------ survival
from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators import survival as SV  # noqa: E402
from tidemark.plans import oracle_survival as OS  # noqa: E402


def _sv(name: str, extra: str = "") -> str:
    body, ctes = OS.SURVIVAL[name]
    parts = [OS.SURV_CTES] + ([ctes] if ctes else []) + ([extra] if extra else [])
    return with_ctes(body, ",".join(parts))


def _sd(s, d):
    return SV.surv_dataset(wh(s, d).customers, K.ORDERS_AS_OF)


register("surv_dataset", _sv("surv_dataset"))(
    lambda s, d: _sd(s, d).select("customer_id", "plan_tier", "industry", "event", "duration_days"))
register("surv_km_tier", _sv("surv_km_tier"))(lambda s, d: SV.km_curve(_sd(s, d), F.col("plan_tier")))
register("surv_km_industry", _sv("surv_km_industry"))(lambda s, d: SV.km_curve(_sd(s, d), F.col("industry")))
register("surv_km_all", _sv("surv_km_all"))(lambda s, d: SV.km_curve(_sd(s, d)))
register("surv_median", _sv("surv_median"))(lambda s, d: SV.km_median(SV.km_curve(_sd(s, d), F.col("plan_tier"))))
register("surv_at_t", _sv("surv_at_t"))(lambda s, d: SV.km_at(SV.km_curve(_sd(s, d), F.col("plan_tier"))))
register("surv_logrank_starter_enterprise", _sv("surv_logrank_starter_enterprise"))(
    lambda s, d: SV.logrank_two(_sd(s, d).where(F.col("plan_tier").isin("starter", "enterprise")),
                                F.col("plan_tier") == "starter", "starter_vs_enterprise"))
register("surv_dropout_90d", _sv("surv_dropout_90d"))(lambda s, d: SV.dropout_90d(_sd(s, d)))
register("surv_dropout_90d_pivot", _sv("surv_dropout_90d_pivot"))(lambda s, d: SV.dropout_90d_pivot(_sd(s, d)))
register("surv_time_to_upgrade", _sv("surv_time_to_upgrade"))(
    lambda s, d: SV.km_curve(SV.upgrade_dataset(wh(s, d).customers, K.ORDERS_AS_OF), F.col("plan_tier")))
register("surv_hazard", _sv("surv_hazard"))(lambda s, d: SV.hazard_curve(_sd(s, d)))
register("surv_hazard_peak", _sv("surv_hazard_peak"))(lambda s, d: SV.hazard_peak(SV.hazard_curve(_sd(s, d))))


def _activation(s, d):
    feats = _eda(s, d).select("customer_id", (F.col("integration_connects_first_30d") >= 3).alias("activated"))
    return _sd(s, d).join(feats, "customer_id")


register("surv_activation_split", with_ctes(
    OS.km_sql("(SELECT sd.*, e.integration_connects_first_30d >= 3 AS activated FROM sd JOIN eda_feats e USING (customer_id))",
              "CASE WHEN activated THEN 'true' ELSE 'false' END"),
    OA.ANALYSIS_CTES + "," + OS.SURV_CTES))(
    lambda s, d: SV.km_curve(_activation(s, d), F.when(F.col("activated"), "true").otherwise("false")))


def _logrank_tests(s, d):
    sd = _sd(s, d)
    two = SV.logrank_two(sd.where(F.col("plan_tier").isin("starter", "enterprise")),
                         F.col("plan_tier") == "starter", "starter_vs_enterprise") \
        .unionByName(SV.logrank_two(_activation(s, d), F.col("activated"), "activated_vs_not"))
    two = SV.with_chi2_p(two).select("test", F.lit(2).cast("long").alias("groups"), "chi2", "df", "p_value")
    tiers = [r[0] for r in sd.select("plan_tier").distinct().orderBy("plan_tier").collect()]  # <= 5 tier names
    k = SV.logrank_k(sd, "plan_tier", tiers)
    return two.unionByName(k.select("test", "groups", "chi2", "df", "p_value"))


register("surv_logrank_tests")(_logrank_tests)

# ------------------------------------------------------------ drift
from tidemark.operators import drift as DR  # noqa: E402
from tidemark.plans import oracle_drift as OD  # noqa: E402
from tidemark.functions.columns import lit_date  # noqa: E402


def _drift_train(s, d):
    return train_churn(s, d).where(F.col("signup_date") < lit_date(K.ORDERS_TRAIN_CUTOFF))


def _drift_prod(s, d):
    return wh(s, d).churn_features


def _baseline(s, d):
    """The baseline is a 12-row table reused by PSI and KS: checkpointed once
    (lineage cut, files in the shared checkpoint folder)."""
    return DR.baseline(_drift_train(s, d)).checkpoint(eager=True)


register("drift_baseline_stats", with_ctes(OD.DRIFT["drift_baseline_stats"], OD.DRIFT_CTES))(
    lambda s, d: DR.baseline_stats(_drift_train(s, d)).select(
        "feature", "n", "min", "max", DR._r6(F.col("mean")).alias("mean"), DR._r6(F.col("std")).alias("std")))


def _hist(s, d):
    t = _drift_train(s, d)
    h = DR.baseline_hist(t, DR.baseline_stats(t))
    return h.select("feature", "bin", *[DR._r6(F.col(c)).alias(c) for c in ("lower_edge", "upper_edge", "share")])


register("drift_baseline_hist", with_ctes(OD.DRIFT["drift_baseline_hist"], OD.DRIFT_CTES))(_hist)
register("drift_psi", with_ctes(OD.DRIFT["drift_psi"], OD.DRIFT_CTES))(
    lambda s, d: DR.psi(_baseline(s, d), _drift_prod(s, d)))
register("drift_ks", with_ctes(OD.DRIFT["drift_ks"], OD.DRIFT_CTES))(lambda s, d: DR.ks(_drift_train(s, d), _drift_prod(s, d)))
register("drift_baseline")(_baseline)


def _report(s, d):
    b = _baseline(s, d)
    return DR.drift_report(DR.psi(b, _drift_prod(s, d)), DR.ks(_drift_train(s, d), _drift_prod(s, d)), K.ORDERS_AS_OF)


def _report_rows(s, d):
    """The report with the list of drifted features as text."""
    return _report(s, d).withColumn("drifted_features", F.array_join("drifted_features", ","))


register("drift_report", with_ctes(OD.DRIFT["drift_report"], OD.DRIFT_CTES))(_report_rows)
register("drift_decision", with_ctes(OD.DRIFT["drift_decision"], OD.DRIFT_CTES))(lambda s, d: DR.retrain_decision(_report(s, d)))
register("drift_guidance", with_ctes(OD.DRIFT["drift_guidance"], OD.DRIFT_CTES))(lambda s, d: DR.drift_guidance(_report(s, d)))

# ------------------------------------------------------------ two-sample tests
import datetime as _dt  # noqa: E402

from tidemark.operators import experiments as EX  # noqa: E402
from tidemark.operators import two_sample as TS  # noqa: E402
from tidemark.plans import oracle_tests as OT  # noqa: E402


def _t(name: str) -> str:
    return with_ctes(OT.TESTS[name], OT.TEST_CTES)


def _events_of(days, event_type):
    return days.where(F.col("event_type") == event_type).groupBy("customer_id").agg(F.sum("n").alias("v"))


def _recent_events(w, n_days=30):
    """customer_id, v: events of the last ``n_days`` to the instant of the latest one. Whole days come from the
    rollup; raw events are read of two days only, the last one (for that instant) and the one the bound falls in."""
    e, days = w.usage_events, w.event_days
    last = days.agg(F.max("day")).first()[0]  # single values, so that the filters reach the scans
    if last is None:
        return days.groupBy("customer_id").agg(F.sum("n").alias("v"))
    latest = e.where(F.col("timestamp") >= F.lit(last).cast("timestamp")).agg(F.max("timestamp")).first()[0]
    bound, day = F.lit(latest) - F.expr(f"INTERVAL {n_days} DAYS"), last - _dt.timedelta(days=n_days)
    edge = e.where((F.col("timestamp") >= bound) & (F.col("timestamp") < F.lit(day + _dt.timedelta(days=1)).cast("timestamp")))
    return days.where(F.col("day") > F.lit(day)).select("customer_id", "n").unionByName(
        edge.select("customer_id", F.lit(1).cast("long").alias("n"))).groupBy("customer_id").agg(F.sum("n").alias("v"))


def _mw_frames(s, d):
    w = wh(s, d)
    c, days = w.customers, w.event_days
    recent = _recent_events(w)
    ev30 = c.select("customer_id", F.col("churn_date").isNotNull().alias("g")).join(recent, "customer_id", "left") \
        .select("g", F.coalesce("v", F.lit(0)).alias("v"))
    asof = lit_date(K.ORDERS_AS_OF)
    trials = _events_of(days.where(F.col("day") >= F.date_sub(asof, 30)), "premium_feature_trial")
    tr = c.where(F.col("churn_date").isNull()).select("customer_id", F.col("upgrade_date").isNotNull().alias("g")) \
        .join(trials, "customer_id", "left").select("g", F.coalesce("v", F.lit(0)).alias("v"))
    lim = _events_of(days, "feature_limit_hit")
    li = c.where(F.col("plan_tier") == "free").select("customer_id", F.col("upgrade_date").isNotNull().alias("g")) \
        .join(lim, "customer_id", "left").select("g", F.coalesce("v", F.lit(0)).alias("v"))
    return ev30, tr, li


def _mw_stats(s, d):
    ev30, tr, li = _mw_frames(s, d)
    return (TS.mann_whitney(ev30, "v", F.col("g"), "events_30d_churned_lt_active", "less")
            .unionByName(TS.mann_whitney(tr, "v", F.col("g"), "premium_trials_upgraded_gt_not", "greater"))
            .unionByName(TS.mann_whitney(li, "v", F.col("g"), "free_limit_hits_expanded_gt_not", "greater")))


def _t_frames(s, d):
    w = wh(s, d)
    c = w.customers
    integ = _events_of(w.event_days, "integration_connect")
    a = c.select("customer_id", F.col("churn_date").isNull().alias("g")).join(integ, "customer_id", "left") \
        .select("g", F.coalesce("v", F.lit(0)).alias("v"))
    hp = w.support_tickets.where(F.col("priority").isin(*K.HIGH_PRIORITIES)).groupBy("customer_id") \
        .agg(F.count(F.lit(1)).alias("v"))
    b = c.select("customer_id", F.col("churn_date").isNotNull().alias("g")).join(hp, "customer_id", "left") \
        .select("g", F.coalesce("v", F.lit(0)).alias("v"))
    g = c.select("customer_id", F.col("churn_date").isNotNull().alias("g")) \
        .join(w.risk_signals, "customer_id", "left").select("g", F.col("compliance_gap_score").alias("v")) \
        .where(F.col("v").isNotNull())
    return a, b, g


def _t_stats(s, d):
    a, b, g = _t_frames(s, d)
    return (TS.pooled_t(a, "v", F.col("g"), "integrations_retained_gt_churned")
            .unionByName(TS.pooled_t(b, "v", F.col("g"), "hp_tickets_churned_gt_active"))
            .unionByName(TS.pooled_t(g, "v", F.col("g"), "compliance_gap_churned_gt_active")))


register("test_mann_whitney_stats", _t("test_mann_whitney_stats"))(_mw_stats)
register("test_mann_whitney")(lambda s, d: TS.with_normal_p(_mw_stats(s, d)))
register("test_t_stats", _t("test_t_stats"))(_t_stats)
register("test_t")(lambda s, d: TS.with_t_p(_t_stats(s, d)))
register("test_mean_ratio", _t("test_mean_ratio"))(
    lambda s, d: TS.mean_ratio(_mw_frames(s, d)[0], "v", F.col("g"), "events_30d_churned_vs_active"))

# ------------------------------------------------------------ experiments
ASSIGNMENT_DATE = K.ORDERS_AS_OF - _dt.timedelta(days=90)


def _eligible(s, d):
    return EX.eligibility(wh(s, d).customers, wh(s, d).support_tickets, ASSIGNMENT_DATE)


def _assigned(s, d):
    return EX.assign(_eligible(s, d))


def _outcomes(s, d):
    return EX.outcomes(_assigned(s, d), ASSIGNMENT_DATE)


register("exp_eligibility", _t("exp_eligibility"))(_eligible)
register("exp_assign", _t("exp_assign"))(_assigned)
register("exp_outcomes", _t("exp_outcomes"))(_outcomes)
register("exp_secondary", _t("exp_secondary"))(lambda s, d: EX.secondary(_assigned(s, d), wh(s, d).usage_events, wh(s, d).support_tickets,
                                                     ASSIGNMENT_DATE))
_INTERVAL = ["effect_low_95", "effect_high_95"]
register("exp_posterior", _t("exp_posterior"))(lambda s, d: EX.posterior(_outcomes(s, d)).drop(*_INTERVAL))
register("exp_prior_sensitivity", _t("exp_prior_sensitivity"))(lambda s, d: EX.posterior(_outcomes(s, d), EX.PRIORS).drop(*_INTERVAL))
# quantiles of a difference of Betas have no SQL: tested by brute force
register("exp_effect_interval")(lambda s, d: EX.posterior(_outcomes(s, d), EX.PRIORS).select("prior", "effect_mean", *_INTERVAL))
register("exp_decision", _t("exp_decision"))(lambda s, d: EX.decision(EX.posterior(_outcomes(s, d), EX.PRIORS)))
register("exp_power_at_n")(lambda s, d: EX.power_by_segment(wh(s, d).customers, K.ORDERS_AS_OF))
register("exp_required_n", _t("exp_required_n"))(
    lambda s, d: EX.required_n_by_segment(wh(s, d).customers, K.ORDERS_AS_OF))
register("outreach_lift", _t("outreach_lift"))(lambda s, d: EX.outreach_lift(wh(s, d).expansion_outreach_log))

# ------------------------------------------------------------ Cox model
from tidemark.operators import cox as CX  # noqa: E402


def _cox(s, d):
    w = wh(s, d)
    dur = F.datediff(F.coalesce(F.col("churn_date"), lit_date(K.ORDERS_AS_OF)), F.col("signup_date"))
    surv = w.customers.select("customer_id", "plan_tier", F.col("churn_date").isNotNull().cast("int").alias("event"),
                              dur.alias("duration_days"))
    tiers = sorted(r[0] for r in w.customers.select("plan_tier").distinct().collect())  # <= 5 names
    frame = CX.cox_frame(_eda(s, d), surv, CO.EDA_FEATURES, tiers)
    return CX.fit_cox(frame, CO.EDA_FEATURES + [f"tier_{t}" for t in tiers[1:]])


register("surv_cox")(_cox)
