"""Two-sample tests on table aggregates.

Mann-Whitney U: value counts per (value, group) -> cumulative counts in
value order (distributed, see ranking) -> average ranks -> U and the
tie-corrected normal approximation with continuity correction.
Pooled t: count / mean / sample variance per group, one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats as ST
from tidemark.operators import ranking


def _r9(c: Column) -> Column:
    return F.round(c.cast("decimal(38,12)"), 9).cast("double")


def mann_whitney(df: DataFrame, value: str, in_first: Column, name: str, alternative: str = "greater") -> DataFrame:
    """U for the first sample (rows where ``in_first``) vs the rest."""
    vc = df.groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("cnt"), F.count_if(in_first).alias("c1"))
    cum = ranking.prefix_sums(vc, ["v"], ["cnt"])
    ranked = cum.select("cnt", "c1", (F.col("cnt_before") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))
    agg = ranked.agg(
        F.sum("c1").cast("double").alias("n1"), (F.sum("cnt") - F.sum("c1")).cast("double").alias("n2"),
        F.sum(F.col("c1") * F.col("avg_rank")).alias("r1"),
        F.sum(F.pow(F.col("cnt"), 3) - F.col("cnt")).alias("tie"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = u1 if alternative == "greater" else n1 * n2 - u1
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / sigma
    return agg.select(F.lit(name).alias("test"), F.lit(alternative).alias("alternative"),
                      n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                      _r9(u1).alias("u_statistic"), _r9(z).alias("z"))


def with_normal_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", ST.norm_sf_udf(F.col("z")))


def pooled_t(df: DataFrame, value: str, in_first: Column, name: str) -> DataFrame:
    """One-sided pooled two-sample t (first > second)."""
    v = F.col(value).cast("double")
    agg = df.agg(
        F.count(F.when(in_first, v)).cast("double").alias("n1"), F.avg(F.when(in_first, v)).alias("m1"),
        F.var_samp(F.when(in_first, v)).alias("v1"),
        F.count(F.when(~in_first, v)).cast("double").alias("n2"), F.avg(F.when(~in_first, v)).alias("m2"),
        F.var_samp(F.when(~in_first, v)).alias("v2"))
    n1, n2 = F.col("n1"), F.col("n2")
    sp2 = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(sp2 * (1 / n1 + 1 / n2))
    return agg.select(F.lit(name).alias("test"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                      _r9(F.col("m1")).alias("mean1"), _r9(F.col("m2")).alias("mean2"), _r9(t).alias("t_stat"),
                      (n1 + n2 - 2).cast("long").alias("df"))


def with_t_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", ST.t_sf_udf(F.col("t_stat"), F.col("df").cast("double")))


def mean_ratio(df: DataFrame, value: str, in_first: Column, name: str, ratio: float = 0.6) -> DataFrame:
    """first-group mean < ratio x second-group mean."""
    v = F.col(value).cast("double")
    a = df.agg(F.avg(F.when(in_first, v)).alias("m1"), F.avg(F.when(~in_first, v)).alias("m2"))
    return a.select(F.lit(name).alias("test"), _r9(F.col("m1")).alias("mean1"), _r9(F.col("m2")).alias("mean2"),
                    (F.col("m1") < ratio * F.col("m2")).alias("passed"))
