"""Feature drift: baseline, PSI, exact two-sample KS and the report.

* baseline: one aggregation for all features over an unpivoted (feature,
  value) view: min, max, mean, sample std, count; a second pass buckets values
  into 10 equal-width bins.
* PSI: production values are bucketed against the widened baseline edges
  (12-row baseline table, broadcast: size bounded by the feature list).
* KS: over the value counts of both sides and their prefix sums; all rows count.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.operators import ranking


def _r6(c: Column) -> Column:
    return F.round(c.cast("decimal(38,12)"), 6).cast("double")


def unpivot(df: DataFrame, features: list[str], id_col: str = "customer_id") -> DataFrame:
    present = [f for f in features if f in df.columns]
    args = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in present)
    return df.select(id_col, F.expr(f"stack({len(present)}, {args}) AS (feature, value)")) \
             .where(F.col("value").isNotNull() & ~F.isnan("value"))


def baseline_stats(train: DataFrame, features: list[str] = K.DRIFT_FEATURES) -> DataFrame:
    long = unpivot(train, features)
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def _equal_width_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy.histogram equal-width bin: index from (v - lo) * (bins / (hi - lo)),
    corrected against the edges lo + i * width; last bin right-closed;
    lo == hi widens the range by 0.5 on both sides."""
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    width = (hi2 - lo2) / bins
    idx = F.least(F.greatest(F.floor((v - lo2) * (F.lit(bins) / (hi2 - lo2))).cast("int"), F.lit(0)),
                  F.lit(bins - 1))
    idx = F.when((v < lo2 + idx * width) & (idx > 0), idx - 1).otherwise(idx)
    idx = F.when((v >= lo2 + (idx + 1) * width) & (idx < bins - 1), idx + 1).otherwise(idx)
    return idx


def baseline_hist(train: DataFrame, stats: DataFrame, features: list[str] = K.DRIFT_FEATURES,
                  bins: int = K.DRIFT_BINS) -> DataFrame:
    long = unpivot(train, features).join(F.broadcast(stats.select("feature", "min", "max", "n")), "feature")
    counted = long.groupBy("feature", _equal_width_bin(F.col("value"), F.col("min"), F.col("max"), bins)
                           .alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = stats.select("feature", "min", "max", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.when(F.col("min") == F.col("max"), F.col("min") - 0.5).otherwise(F.col("min"))
    hi = F.when(F.col("min") == F.col("max"), F.col("max") + 0.5).otherwise(F.col("max"))
    width = (hi - lo) / bins
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature", F.col("bin").cast("long").alias("bin"),
        (lo + F.col("bin") * width).alias("lower_edge"),
        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("upper_edge"),
        (F.coalesce("c", F.lit(0)) / F.col("n")).alias("share"))


def baseline(train: DataFrame, features: list[str] = K.DRIFT_FEATURES) -> DataFrame:
    """One row per feature: n, min, max, mean, std, bins (11 edges), hist (10 shares)."""
    stats = baseline_stats(train, features)
    hist = baseline_hist(train, stats, features)
    h = hist.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("bin", "lower_edge", "upper_edge", "share"))).alias("_h"))
    h = h.select("feature",
                 F.concat(F.transform("_h", lambda x: x["lower_edge"]),
                          F.array(F.element_at("_h", -1)["upper_edge"])).alias("bins"),
                 F.transform("_h", lambda x: x["share"]).alias("hist"))
    return stats.join(h, "feature")


def psi(base: DataFrame, prod: DataFrame, features: list[str] = K.DRIFT_FEATURES,
        min_rows: int = K.DRIFT_MIN_ROWS) -> DataFrame:
    """PSI per feature against the baseline bins. A feature with fewer than
    ``min_rows`` production values, or none in the baseline, stays in the result
    with status 'insufficient_rows' and no figures."""
    long = unpivot(prod, features)
    pstats = long.groupBy("feature").agg(F.count(F.lit(1)).alias("pn"), F.min("value").alias("pmin"),
                                         F.max("value").alias("pmax"))
    every = base.select("feature").union(pstats.select("feature")).distinct()
    b = base.select("feature", "bins", "hist").join(pstats.where(F.col("pn") >= min_rows), "feature")
    b = b.withColumn("edges", F.concat(
        F.array(F.least(F.element_at("bins", 1), F.col("pmin")) - K.PSI_EDGE_WIDEN),
        F.slice("bins", 2, K.DRIFT_BINS - 1),
        F.array(F.greatest(F.element_at("bins", -1), F.col("pmax")) + K.PSI_EDGE_WIDEN)))
    inner = F.slice(F.col("edges"), 2, K.DRIFT_BINS - 1)
    idx = F.aggregate(inner, F.lit(0), lambda acc, e: acc + F.when(F.col("value") >= e, 1).otherwise(0))
    binned = long.join(F.broadcast(b.select("feature", "edges")), "feature") \
        .groupBy("feature", idx.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = b.select("feature", "pn", F.posexplode("hist").alias("bin", "expected"))
    j = grid.join(binned, ["feature", "bin"], "left")
    a = F.coalesce("c", F.lit(0)) / F.col("pn")
    e = F.col("expected")
    term = (a - e) * F.log((a + K.PSI_EPS) / (e + K.PSI_EPS))
    out = j.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("psi"))
    return every.join(out, "feature", "left").select(
        "feature", _r6(F.col("psi")).alias("psi"), F.when(F.col("psi").isNotNull(), psi_level(F.col("psi"))).alias("psi_level"),
        _status(F.col("psi")).alias("status"))


def _status(figure: Column) -> Column:
    return F.when(figure.isNull(), "insufficient_rows").otherwise("ok")


def psi_level(p: Column) -> Column:
    return F.when(p < K.PSI_MODERATE, "no_drift").when(p < K.PSI_ALERT, "moderate").otherwise("alert")


def kolmogorov_tail(lam: Column) -> Column:
    """Asymptotic two-sided Kolmogorov tail 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2), k to 100."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)),
                        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


#: Sizes whose product is at most this get the exact p-value.
EXACT_PATHS = 10_000


def ks_exact_tail(d: Column, m: Column, n: Column) -> Column:
    """P(D >= d) of two samples of m and n values without ties, exactly: the share of
    lattice paths from (0, 0) to (m, n) that leave the band |i / m - j / n| < d.

    The share of paths inside up to (i, j) among all paths there is i / (i + j) times
    that at (i - 1, j) plus j / (i + j) times that at (i, j - 1), or 0 outside the
    band, so no count overflows. A row of the lattice is an array; m + 1 rows are
    folded. Distances compare as whole numbers i * n - j * m."""
    reach = F.round(d * m * n).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), n)

    def along(row: Column, i: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            left = F.when(j > 0, F.element_at(acc, -1)).otherwise(F.lit(0.0))
            above = F.when(i > 0, F.get(row, j.cast("int"))).otherwise(F.lit(0.0))
            share = F.when(i + j == 0, 1.0).otherwise((i * above + j * left) / (i + j))
            return F.concat(acc, F.array(F.when(F.abs(i * n - j * m) < reach, share).otherwise(0.0)))
        return F.aggregate(steps, F.array().cast("array<double>"), step)
    last = F.aggregate(F.sequence(F.lit(0).cast("long"), m), F.array().cast("array<double>"), along)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.element_at(last, -1)))


def ks(train: DataFrame, prod: DataFrame, features: list[str] = K.DRIFT_FEATURES,
       min_rows: int = K.DRIFT_MIN_ROWS) -> DataFrame:
    """Exact two-sample KS statistic and p-value per feature: the p-value is exact
    (``ks_method``) where the product of the sizes is small, else asymptotic.

    Both sides are aggregated to value counts (combined before the shuffle), the
    counts are prefix-summed in (feature, value) order, and the statistic is the
    largest distance of the two distribution functions at any value: all rows
    count, none is sampled. Features short of rows keep a row (see ``psi``)."""
    both = unpivot(train, features).select("feature", "value", F.lit(1).alias("b"), F.lit(0).alias("p")).unionByName(
        unpivot(prod, features).select("feature", "value", F.lit(0).alias("b"), F.lit(1).alias("p")))
    counts = both.groupBy("feature", (F.col("value") + 0.0).alias("value")).agg(
        F.sum("b").cast("long").alias("cb"), F.sum("p").cast("long").alias("cp"))
    run = ranking.prefix_sums(counts, ["feature", "value"], ["cb", "cp"])
    sizes = run.groupBy("feature").agg(F.sum("cb").alias("m"), F.sum("cp").alias("n"),
                                       F.min("cb_before").alias("b0"), F.min("cp_before").alias("p0"))  # a row per feature
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    gap = F.abs((F.col("cb_before") - F.col("b0") + F.col("cb")) / m - (F.col("cp_before") - F.col("p0") + F.col("cp")) / n)
    stat = run.join(F.broadcast(sizes), "feature").groupBy("feature").agg(
        F.max(gap).alias("d"), F.first("m").alias("m"), F.first("n").alias("n"))
    enough = (F.col("n") >= min_rows) & (F.col("m") > 0)
    small = F.col("m") * F.col("n") <= EXACT_PATHS
    stat = stat.select("feature", "m", "n", F.when(enough, F.col("d")).alias("d"), F.sqrt(m * n / (m + n)).alias("en"))
    p = F.when(small, ks_exact_tail(F.col("d"), F.col("m"), F.col("n"))).otherwise(kolmogorov_tail(F.col("en") * F.col("d")))
    return stat.select("feature", _r6(F.col("d")).alias("ks_stat"), _r6(F.when(F.col("d").isNotNull(), p)).alias("ks_pvalue"),
                       F.when(F.col("d").isNotNull(), F.when(small, "exact").otherwise("asymptotic")).alias("ks_method"), _status(F.col("d")).alias("status"))


def drift_report(psi_df: DataFrame, ks_df: DataFrame, as_of: _dt.date) -> DataFrame:
    """Per-feature rows plus the summary columns repeated on each row
    (max PSI, min KS p, drifted list, has_drift)."""
    either = F.when((F.col("status") == "ok") & (F.col("ks_status") == "ok"), "ok").otherwise("insufficient_rows")
    j = psi_df.join(ks_df.withColumnRenamed("status", "ks_status"), "feature", "full").withColumn("status", either)
    over = (F.col("psi") > K.PSI_ALERT) | (F.col("ks_pvalue") < K.KS_ALPHA)
    j = j.withColumn("drift_detected", F.coalesce(over, F.lit(False)))
    all_w = Window.partitionBy()  # over the <= 12 feature rows
    return j.select(
        F.lit(as_of).alias("checked_at"), "feature", "psi", "psi_level", "ks_stat", "ks_pvalue", "status",
        "drift_detected", F.max("psi").over(all_w).alias("max_psi"), F.min("ks_pvalue").over(all_w).alias("min_ks_pvalue"),
        F.max(F.col("drift_detected").cast("int")).over(all_w).cast("boolean").alias("has_drift"),
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature"))).over(all_w))
         .alias("drifted_features"))


def retrain_decision(report: DataFrame, psi_limit: float = K.PSI_ALERT, p_limit: float = K.KS_ALPHA) -> DataFrame:
    """Retrain if any feature crosses the (overridable) limits."""
    return report.agg(
        F.max("psi").alias("max_psi"), F.min("ks_pvalue").alias("min_ks_pvalue"),
        F.coalesce(F.bool_or((F.col("psi") > psi_limit) | (F.col("ks_pvalue") < p_limit)), F.lit(False)).alias("retrain"))


def drift_guidance(report: DataFrame) -> DataFrame:
    """PSI x KS matrix: both -> retrain; KS only -> likely sampling artefact; PSI only -> investigate."""
    hp = F.col("psi") > K.PSI_ALERT
    hk = F.col("ks_pvalue") < K.KS_ALPHA
    g = (F.when(hp & hk, "retrain").when(~hp & hk, "sampling_artefact").when(hp & ~hk, "investigate")
          .when(F.col("status") != "ok", "insufficient_rows").otherwise("stable"))
    return report.select("feature", "psi", "ks_pvalue", g.alias("guidance"))
