"""Model queries: metric operators on the rule score (SQL-checked), and the
calibrated GBT models (trained once per data set, persisted, then reused)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date, tier
from tidemark.operators import metrics as MT
from tidemark.operators import models as MD
from tidemark.operators import risk as RK
from tidemark.operators import scoring as SC
from tidemark.operators import survival as SV
from tidemark.plans import oracle_models as OMD
from tidemark.plans.catalog import register, wh
from tidemark.plans.oracle_base import with_ctes
from tidemark.plans.queries_analysis import train_churn, train_expansion
from tidemark.sources.driver_tables import read_table

# ------------------------------------------------------------ rule score as a predictor (point in time)


def rule_eval(s, d):
    """Rule churn score computed on each customer's point-in-time features, with
    the churn label: a leakage-free evaluation set for the metric operators."""
    p = train_churn(s, d).withColumn("is_early_stage", F.col("is_early_stage").cast("boolean"))
    r = RK.mart_risk_scores(p)
    lab = p.select("customer_id", "label", "signup_date")
    return r.select("customer_id", F.col("churn_score").cast("double").alias("score"), "mrr", "plan_tier") \
            .join(lab, "customer_id")


def _m(name):
    return with_ctes(OMD.MODELS[name], OMD.MODEL_CTES)


register("ml_auc_churn_rule", _m("ml_auc_churn_rule"))(lambda s, d: MT.auc(rule_eval(s, d)))
register("ml_brier_churn_rule", _m("ml_brier_churn_rule"))(lambda s, d: MT.brier(rule_eval(s, d)))
register("ml_precision_top_decile_rule", _m("ml_precision_top_decile_rule"))(
    lambda s, d: MT.precision_top_decile(rule_eval(s, d)))
register("ml_calibration_curve_rule", _m("ml_calibration_curve_rule"))(
    lambda s, d: MT.calibration_curve(rule_eval(s, d)))
register("ml_decile_table_rule", _m("ml_decile_table_rule"))(lambda s, d: MT.decile_table(rule_eval(s, d)))
register("ml_decile_lift_rule", _m("ml_decile_lift_rule"))(
    lambda s, d: MT.decile_lift(SC.expansion_scoring(wh(s, d).propensity_quadrant), "propensity",
                                "expected_arr_uplift"))
register("ml_class_weight", _m("ml_class_weight"))(
    lambda s, d: MD.with_class_weight(train_churn(s, d).select("customer_id", F.col("label").cast("double")
                                                               .alias("label")))
    .groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("weight").cast("decimal(38,12)"), 9)
                          .cast("double").alias("weight")))
register("ml_ordinal_encode", _m("ml_ordinal_encode"))(
    lambda s, d: wh(s, d).customers.select("customer_id", MD.ordinal(F.col("plan_tier"), K.PLAN_TIERS)
                                           .alias("plan_tier_code"),
                                           MD.ordinal(F.col("industry"), K.INDUSTRIES).alias("industry_code")))


def _standardised(s, d):
    """z-scores with the population standard deviation; a constant column gives 0.
    Two numbers per feature reach the driver."""
    df = train_churn(s, d)
    feats = [c for c in K.CHURN_NUMERIC_FEATURES]
    st = df.agg(*[x for c in feats for x in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                                             F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))]).first()
    return df.select("customer_id", *[MT._r9((F.col(c).cast("double") - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"] or 1.0))
                                      .alias(c) for c in feats])


register("ml_standardise", _m("ml_standardise"))(_standardised)

# ------------------------------------------------------------ calibrated GBT models


def _key(s, d, name):
    """Models are keyed by the warehouse (inputs + as_of + layout) and the split."""
    from tidemark.plans.warehouse import code_fingerprint
    code = code_fingerprint(["operators/boosting.py", "operators/models.py", "plans/queries_models.py"])
    return f"{name}-{wh(s, d).key}-{K.ORDERS_TRAIN_CUTOFF.isoformat()}-{code}"


CHURN_X = K.CHURN_NUMERIC_FEATURES
EXP_X = K.EXPANSION_NUMERIC_FEATURES


def _churn_frames(s, d):
    f = MD.model_frame(train_churn(s, d), CHURN_X)
    sign = train_churn(s, d).select("customer_id", "signup_date")
    f = f.join(sign, "customer_id")
    cut = lit_date(K.ORDERS_TRAIN_CUTOFF)
    return f.where(F.col("signup_date") < cut), f.where(F.col("signup_date") >= cut)


def _exp_frames(s, d):
    f = MD.model_frame(train_expansion(s, d), EXP_X)
    sign = train_expansion(s, d).select("customer_id", "signup_date")
    f = f.join(sign, "customer_id")
    cut = lit_date(K.ORDERS_TRAIN_CUTOFF)
    return f.where(F.col("signup_date") < cut), f.where(F.col("signup_date") >= cut)


def churn_model(s, d):
    return MD.fit_or_load(s, _key(s, d, "churn"), lambda: _churn_frames(s, d)[0])


def expansion_model(s, d):
    return MD.fit_or_load(s, _key(s, d, "expansion"), lambda: _exp_frames(s, d)[0])


def _scored(s, d, name, build):
    """A scored table, stored once: the ensembles of 1,500 trees are not evaluated
    again for every metric that reads it."""
    return wh(s, d)._table(f"scored-{_key(s, d, name)}", build)


def _test_scores(s, d, which):
    return _scored(s, d, f"test-{which}", lambda: _score_test(s, d, which))


def _score_test(s, d, which):
    model = churn_model(s, d) if which == "churn" else expansion_model(s, d)
    test = (_churn_frames if which == "churn" else _exp_frames)(s, d)[1]
    return model.predict(test).select("customer_id", "label", F.col("probability_calibrated").alias("score"),
                                      F.col("mrr_raw").alias("mrr"), F.col("plan_tier_name").alias("plan_tier"))


def _metrics(s, d, which):
    t = _test_scores(s, d, which)
    gates = MD.CHURN_GATES if which == "churn" else MD.EXPANSION_GATES
    a = MT.auc(t).select("auc")
    b = MT.brier(t)
    p = MT.precision_top_decile(t)
    m = (a.select("auc", F.lit(None).cast("double").alias("brier"))
         .unionByName(b.select(F.lit(None).cast("double").alias("auc"), "brier"))
         .agg(F.max("auc").alias("auc"), F.max("brier").alias("brier")))
    m = MT.accuracy_gate(m, gates["auc_min"], gates["brier_max"])
    pp = p.select("precision_top_n", "precision_above_p90")
    return _combine(m, pp, which)


def _combine(m, pp, which):
    left = m.select(F.lit(which).alias("model"), "auc", "brier", "auc_passed", "brier_passed", "stage")
    right = pp.select(F.lit(which).alias("model"), "precision_top_n", "precision_above_p90")
    return left.join(right, "model")


register("ml_metrics_churn")(lambda s, d: _metrics(s, d, "churn"))
register("ml_metrics_expansion")(lambda s, d: _metrics(s, d, "expansion"))
register("ml_calibration_curve_churn")(lambda s, d: MT.calibration_curve(_test_scores(s, d, "churn")))
register("ml_decile_table_churn")(lambda s, d: MT.decile_table(_test_scores(s, d, "churn")))


def _importance(s, d, which):
    model = churn_model(s, d) if which == "churn" else expansion_model(s, d)
    names = (CHURN_X if which == "churn" else EXP_X) + ["plan_tier", "industry"]
    return MD.feature_importance(model, names)


register("ml_feature_importance_churn")(lambda s, d: _importance(s, d, "churn"))
register("ml_leakage_guard")(lambda s, d: _importance(s, d, "expansion").where(F.col("rank") == 1).select(
    "feature", "importance", (F.col("feature") == "has_open_expansion_opp").alias("leakage_warning")))


def batch_score_churn(s, d):
    """Every active customer at as_of: calibrated probability, tier, action flag."""
    return _scored(s, d, "batch-churn", lambda: _batch_score_churn(s, d))


def _batch_score_churn(s, d):
    mart = wh(s, d).churn_features
    frame = MD.model_frame(mart, CHURN_X, label=None)
    p = churn_model(s, d).predict(frame).select("customer_id", F.col("probability_calibrated").alias("p"))
    return p.select("customer_id", F.col("p").alias("churn_probability"), tier(F.col("p")).alias("risk_tier"),
                    (F.col("p") >= 0.5).alias("requires_action"),
                    F.lit(K.ORDERS_AS_OF.isoformat()).alias("scored_at"), F.lit("gbt-cal-1").alias("model_version"))


register("ml_batch_score_churn")(batch_score_churn)
register("ml_batch_score_churn_summary")(lambda s, d: batch_score_churn(s, d).agg(
    F.count(F.lit(1)).alias("n_scored"), F.avg(F.col("requires_action").cast("double")).alias("high_risk_share"),
    F.avg("churn_probability").alias("mean_probability")))


def batch_score_expansion(s, d):
    return _scored(s, d, "batch-expansion", lambda: _batch_score_expansion(s, d))


def _batch_score_expansion(s, d):
    mart = wh(s, d).expansion_features
    frame = MD.model_frame(mart, EXP_X, label=None)
    p = expansion_model(s, d).predict(frame).select("customer_id", F.col("probability_calibrated").alias("propensity"))
    c = batch_score_churn(s, d).select("customer_id", "churn_probability")
    j = mart.select("customer_id", "plan_tier", "mrr").join(p, "customer_id").join(c, "customer_id", "left")
    up = RK.expected_uplift(F.col("plan_tier"), F.col("mrr"), F.col("propensity"))
    j = j.withColumn("expected_arr_uplift", up)
    return j.select("customer_id", "plan_tier", "propensity", tier(F.col("propensity")).alias("propensity_tier"),
                    RK.next_tier(F.col("plan_tier")).alias("target_tier"), "expected_arr_uplift",
                    RK.high_value_target(F.col("plan_tier"), F.col("propensity"), F.col("expected_arr_uplift"))
                    .alias("is_high_value_target"),
                    RK.expansion_action(F.col("plan_tier"), F.col("propensity"), F.col("expected_arr_uplift"),
                                        F.col("churn_probability")).alias("recommended_action"))


register("ml_batch_score_expansion")(batch_score_expansion)
register("ml_decile_lift_expansion")(lambda s, d: MT.decile_lift(batch_score_expansion(s, d), "propensity",
                                                                  "expected_arr_uplift"))


def calibration_by_tier(s, d):
    """Mean predicted churn per tier on the test split vs 1 - KM(365) per tier."""
    t = _test_scores(s, d, "churn").groupBy("plan_tier").agg(F.avg("score").alias("mean_predicted"))
    km = SV.km_at(SV.km_curve(SV.surv_dataset(wh(s, d).customers, K.ORDERS_AS_OF), F.col("plan_tier")), (365,))
    j = t.join(km.select(F.col("stratum").alias("plan_tier"), (1 - F.col("s_365")).alias("km_churn_365")),
               "plan_tier", "left")
    return j.withColumn("gap", F.abs(F.col("mean_predicted") - F.col("km_churn_365"))) \
            .withColumn("passed", F.col("gap") <= 0.15)


register("ml_calibration_by_tier")(calibration_by_tier)


def model_metadata(s, d):
    tr, te = _churn_frames(s, d)
    a = tr.select(F.lit(1).alias("is_train"), "label").unionByName(te.select(F.lit(0).alias("is_train"), "label"))
    g = a.agg(F.sum("is_train").alias("n_train"), F.sum(1 - F.col("is_train")).alias("n_test"),
              F.avg(F.when(F.col("is_train") == 1, F.col("label"))).alias("churn_rate_train"),
              F.avg(F.when(F.col("is_train") == 0, F.col("label"))).alias("churn_rate_test"))
    m = _metrics(s, d, "churn")
    return g.select(F.lit("churn").alias("model"), "n_train", "n_test", "churn_rate_train", "churn_rate_test",
                    F.lit(",".join(CHURN_X + ["plan_tier", "industry"])).alias("features"),
                    F.lit(str(MD.GBT_PARAMS)).alias("params")).join(m, "model")


register("ml_model_metadata")(model_metadata)

# ------------------------------------------------------------ attribution
from tidemark.operators import attribution as AT  # noqa: E402

# fixed values: signals the original expects among the top-2 global attributions
KNOWN_CHURN_SIGNALS = ["events_last_30d", "avg_adoption_score", "retention_signal_count",
                       "days_since_last_event", "high_priority_tickets"]


def _attr(s, d, which):
    model = churn_model(s, d) if which == "churn" else expansion_model(s, d)
    mart = wh(s, d).churn_features if which == "churn" else wh(s, d).expansion_features
    xs = CHURN_X if which == "churn" else EXP_X
    frame = MD.model_frame(mart, xs, label=None)
    saved = f"{model.path}/full" if model.path else None
    return AT.attribute(frame, model.full, xs + ["plan_tier", "industry"], saved_dir=saved)


register("ml_attribution_row")(lambda s, d: _attr(s, d, "churn").select(
    "customer_id", "base_value", "margin", "top_features"))
register("ml_attribution_row_expansion")(lambda s, d: _attr(s, d, "expansion").select(
    "customer_id", "base_value", "margin", "top_features"))


def _global(s, d):
    g = AT.global_importance(_attr(s, d, "churn"), CHURN_X + ["plan_tier", "industry"])
    top2 = F.max(F.when((F.col("rank") <= 2) & F.col("feature").isin(*KNOWN_CHURN_SIGNALS), 1).otherwise(0)) \
        .over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy())  # over <= 10 rows
    return g.withColumn("known_signal_in_top2", top2 == 1)


register("ml_attribution_global")(_global)


def _leakage(s, d):
    g = AT.global_importance(_attr(s, d, "expansion"), EXP_X + ["plan_tier", "industry"], top_k=1)
    return g.select("feature", "mean_abs_contribution",
                    (F.col("feature") == "has_open_expansion_opp").alias("leakage_warning"))


register("ml_leakage_guard_attribution")(_leakage)

# ------------------------------------------------------------ small feature/ML items
from tidemark.operators import features as FT  # noqa: E402
from tidemark.operators import quality as Q  # noqa: E402

register("feat_to_model_row", _m("feat_to_model_row"))(
    lambda s, d: FT.to_model_row(wh(s, d).churn_features, CHURN_X))


def _churn_all(s, d):
    """Churn features of every customer, churned ones included, straight from raw."""
    w = wh(s, d)
    return FT.mart_churn_features(w.stg_customers(), w.event_days, w.stg_support_tickets(), K.ORDERS_AS_OF, active_only=False)


def _expansion_all(s, d):
    """Expansion features of every customer."""
    w = wh(s, d)
    return FT.mart_expansion_features(w.stg_customers(), _churn_all(s, d), w.event_days, w.stg_support_tickets(), w.stg_gtm_opportunities(),
                                      w.stg_expansion_outreach(), K.ORDERS_AS_OF, every=True)


register("feat_churn_from_raw", with_ctes("SELECT * EXCLUDE (is_active, is_upgraded, last_event_age, premium_feature_trials_30d, "
                                          "feature_limit_hit_30d, feature_request_tickets_90d) FROM all_features"))(_churn_all)
register("feat_expansion_from_raw", with_ctes("SELECT * EXCLUDE (is_candidate) FROM wanted"))(_expansion_all)


def _split_sizes(s, d):
    tr, te = FT.train_time_split(train_churn(s, d), K.ORDERS_TRAIN_CUTOFF)
    part = tr.select(F.lit("train").alias("split"), "label").unionByName(te.select(F.lit("test").alias("split"), "label"))
    return part.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                     MT._r9(F.avg(F.col("label").cast("double"))).alias("churn_rate"))


register("train_time_split", _m("train_time_split"))(_split_sizes)
register("feat_validation_mart_join", _m("feat_validation_mart_join"))(
    lambda s, d: wh(s, d).expansion_features.select("customer_id", "plan_tier", "premium_feature_trials_30d")
    .join(wh(s, d).customers.select("customer_id", F.col("upgrade_date").isNotNull().cast("long").alias("label")),
          "customer_id"))


def _value_guard(s, d):
    """Rows of the 360 table that break a value-object rule, with the first reason."""
    t = SC.customer_360_table(wh(s, d).risk_scores, wh(s, d).propensity_quadrant,
                              RK.risk_composite(RK.usage_decay(wh(s, d).customers, wh(s, d).event_days,
                                                               K.ORDERS_AS_OF), wh(s, d).risk_signals),
                              wh(s, d).event_days, wh(s, d).support_tickets, wh(s, d).gtm_opportunities,
                              K.ORDERS_AS_OF)
    def in01(c):
        return F.col(c).isNull() | F.col(c).between(0, 1)
    checks = {"churn_probability_out_of_range": in01("churn_probability"),
              "propensity_out_of_range": in01("upgrade_propensity"),
              "risk_score_out_of_range": in01("composite_risk_score"),
              "mrr_negative": F.col("mrr") >= 0}
    _ok, rejected = Q.value_object_guard(t, checks)
    # the raw side, before the adapter's repairs: account balance as revenue, dates, adoption scores
    balance = read_table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_acctbal").alias("raw_mrr"))
    days = wh(s, d).event_days.groupBy("customer_id").agg(F.min(F.col("score_sum") / F.col("score_n")).alias("low"),
                                                         F.max(F.col("score_sum") / F.col("score_n")).alias("high"))
    raw = wh(s, d).customers.join(balance, "customer_id").join(days, "customer_id", "left")
    _ok, raw_rejected = Q.value_object_guard(raw, {
        "mrr_negative": F.col("raw_mrr") >= 0,
        "churn_before_signup": F.col("churn_date").isNull() | (F.col("churn_date") >= F.col("signup_date")),
        "adoption_out_of_range": in01("low") & in01("high")})
    return rejected.select("customer_id", "reject_reason").unionByName(raw_rejected.select("customer_id", "reject_reason"))


register("dq_value_object_guard", with_ctes(OMD.VALUE_GUARD))(_value_guard)


def _expansion_facts(s, d):
    """Verified facts per expansion candidate: model score, tier, uplift, target
    tier and the top-3 attributed signals with their direction."""
    sc = batch_score_expansion(s, d).select("customer_id", "propensity", "propensity_tier", "expected_arr_uplift",
                                            "target_tier")
    att = _attr(s, d, "expansion").select("customer_id", F.slice("top_features", 1, 3).alias("top3"))
    signals = F.transform("top3", lambda t: F.struct(
        t["feature"].alias("feature"), t["contribution"].alias("contribution"),
        F.when(t["contribution"] >= 0, "increases").otherwise("decreases").alias("direction")))
    return sc.join(att, "customer_id").select("customer_id", "propensity", "propensity_tier", "expected_arr_uplift",
                                              "target_tier", signals.alias("top_signals"))


register("ctx_expansion_facts")(_expansion_facts)
