"""Model-quality metrics over a (score, label) table, all distributed.

AUC comes from average ranks of distinct scores (value counts + cumulative
counts), top-decile and decile tables from the distributed global numbering,
percentile edges from ``ranking.exact_quantiles``; nothing is sorted or buffered
in one task and nothing is collected but single numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking


def _r9(c: Column) -> Column:
    return F.round(c.cast("decimal(38,12)"), 9).cast("double")


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC = (sum of positive ranks - P(P+1)/2) / (P N), ties at average rank."""
    vc = df.groupBy(F.col(score).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.col(label).cast("long")).alias("pos"))
    cum = ranking.prefix_sums(vc, ["v"], ["cnt"])
    a = cum.agg(F.sum(F.col("pos") * (F.col("cnt_before") + (F.col("cnt") + 1) / 2.0)).alias("rpos"),
                F.sum("pos").cast("double").alias("P"), (F.sum("cnt") - F.sum("pos")).cast("double").alias("N"))
    return a.select(_r9((F.col("rpos") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))).alias("auc"),
                    F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"))


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.agg(_r9(F.avg(F.pow(F.col(score).cast("double") - F.col(label).cast("double"), 2))).alias("brier"))


def precision_top_decile(df: DataFrame, score: str = "score", label: str = "label",
                         id_col: str = "customer_id") -> DataFrame:
    """Two definitions: the top floor(n/10) rows by score (ties by id), and rows
    with score >= the exact 90th percentile."""
    n = df.count()  # one number
    k = max(1, n // 10)
    pos = ranking.global_positions(df.select(id_col, score, label),
                                   [F.col(score).desc(), F.col(id_col)])
    top = pos.where(F.col("pos") < k).agg(F.avg(F.col(label).cast("double")).alias("p1"))
    t = ranking.exact_quantiles(df, [], score, [0.9]).first()["q0"]  # one number
    p2 = df.where(F.col(score) >= F.lit(t)).agg(F.avg(F.col(label).cast("double")).alias("p2"))
    both = (top.select("p1", F.lit(None).cast("double").alias("p2"))
            .unionByName(p2.select(F.lit(None).cast("double").alias("p1"), "p2"))
            .agg(F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    return both.select(_r9(F.col("p1")).alias("precision_top_n"), _r9(F.col("p2")).alias("precision_above_p90"),
                       F.lit(k).cast("long").alias("top_n"))


def calibration_curve(df: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Equal-width bins, right-closed: bin = greatest(0, ceil(p * bins) - 1)."""
    b = F.greatest(F.lit(0), F.ceil(F.col(score) * bins) - 1).cast("long")
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), _r9(F.avg(F.col(score).cast("double"))).alias("mean_predicted"),
        _r9(F.avg(F.col(label).cast("double"))).alias("fraction_positive"))


def decile_table(df: DataFrame, score: str = "score", label: str = "label", mrr: str = "mrr",
                 id_col: str = "customer_id") -> DataFrame:
    """Rank deciles (1 = highest score): decile = greatest(1, ceil(10 pos / (n-1)))."""
    n = df.count()
    pos = ranking.global_positions(df.select(id_col, score, label, mrr), [F.col(score).desc(), F.col(id_col)])
    dec = F.greatest(F.lit(1), F.ceil(10 * F.col("pos") / F.lit(max(n - 1, 1)))).cast("long")
    return pos.groupBy(dec.alias("decile")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.sum(F.col(label).cast("long")).alias("n_churned"),
        _r9(F.avg(F.col(label).cast("double"))).alias("precision"),
        _r9(F.avg(F.col(mrr).cast("double"))).alias("avg_mrr"),
        _r9(F.sum(F.col(mrr).cast("double")) * 12).alias("total_arr"))


def decile_lift(df: DataFrame, score: str, uplift: str, capture_rate: float = 0.25) -> DataFrame:
    """Value deciles from exact percentile edges (right-closed, lowest included)."""
    found = ranking.exact_quantiles(df, [], score, [i / 10 for i in range(1, 10)]).first()  # 9 numbers
    bucket = F.lit(1)
    for e in (found[f"q{k}"] for k in range(9)):
        bucket = bucket + F.when(F.col(score) > F.lit(e), 1).otherwise(0)
    g = df.groupBy(bucket.cast("long").alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), _r9(F.avg(F.col(score).cast("double"))).alias("mean_propensity"),
        _r9(F.sum(F.col(uplift).cast("double"))).alias("total_arr_uplift"))
    return g.withColumn("captured_arr", _r9(F.col("total_arr_uplift") * capture_rate))


def accuracy_gate(metrics: DataFrame, auc_min: float, brier_max: float) -> DataFrame:
    return metrics.withColumn("auc_passed", F.col("auc") >= auc_min) \
                  .withColumn("brier_passed", F.col("brier") <= brier_max) \
                  .withColumn("stage", F.when(F.col("auc") >= 0.80, "production").otherwise("staging"))
