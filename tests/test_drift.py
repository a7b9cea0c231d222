import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import drift as DR


def _brute_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    allv = np.concatenate([a, b])
    c1 = np.searchsorted(a, allv, side="right") / len(a)
    c2 = np.searchsorted(b, allv, side="right") / len(b)
    return float(np.max(np.abs(c1 - c2)))


def test_ks_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    train = [(f"c{i}", float(v)) for i, v in enumerate(rng.integers(0, 15, 300))]
    prod = [(f"p{i}", float(v)) for i, v in enumerate(rng.integers(2, 20, 400))]
    tdf = spark.createDataFrame(train, "customer_id string, x double")
    pdf = spark.createDataFrame(prod, "customer_id string, x double")
    got = DR.ks(tdf, pdf, ["x"]).collect()[0]
    assert abs(got["ks_stat"] - round(_brute_ks(np.array([v for _, v in train]), np.array([v for _, v in prod])), 6)) < 1e-9
    assert got["status"] == "ok" and 0 <= got["ks_pvalue"] <= 1


def test_ks_uses_all_rows_of_a_large_side(spark):
    """2,000 rows a side that differ only beyond the first hundreds."""
    train = spark.range(2000).selectExpr("cast(id as string) customer_id", "cast(id as double) x")
    prod = spark.range(2000).selectExpr("cast(id as string) customer_id", "cast(if(id < 1500, id, 1500) as double) x")
    got = DR.ks(train, prod, ["x"]).collect()[0]
    assert got["ks_stat"] == round(_brute_ks(np.arange(2000.0), np.minimum(np.arange(2000.0), 1500)), 6)
    assert "Python" not in DR.ks(train, prod, ["x"])._jdf.queryExecution().executedPlan().toString()


def test_short_features_stay_in_the_report(spark):
    import datetime
    train = spark.range(50).selectExpr("cast(id as string) customer_id", "cast(id as double) x", "cast(id as double) y")
    prod = spark.range(50).selectExpr("cast(id as string) customer_id", "cast(id as double) x", "if(id < 5, cast(id as double), null) y")
    base = DR.baseline(train, ["x", "y"])
    report = {r["feature"]: r for r in DR.drift_report(DR.psi(base, prod, ["x", "y"]), DR.ks(train, prod, ["x", "y"]), datetime.date(2001, 8, 1)).collect()}
    assert report["x"]["status"] == "ok"
    assert report["y"]["status"] == "insufficient_rows" and report["y"]["psi"] is None and report["y"]["ks_stat"] is None


def test_psi_zero_for_same_distribution(spark):
    rows = [(f"c{i}", float(i % 37)) for i in range(500)]
    df = spark.createDataFrame(rows, "customer_id string, x double")
    base = DR.baseline(df, ["x"])
    assert DR.psi(base, df, ["x"]).collect()[0]["psi"] == 0.0


def test_equal_width_bins_like_numpy(spark):
    vals = [0.0, 0.1, 0.2, 0.30000000000000004, 0.5, 0.7, 0.9, 1.0]
    df = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(vals)], "customer_id string, x double")
    stats = DR.baseline_stats(df, ["x"])
    h = {r["bin"]: r["share"] for r in DR.baseline_hist(df, stats, ["x"]).collect()}
    counts, _ = np.histogram(vals, bins=10)
    assert [round(h[i] * len(vals)) for i in range(10)] == counts.tolist()


def _paths_tail(d, m, n):
    """Share of lattice paths that reach distance d, by listing whole-number counts."""
    from fractions import Fraction
    from math import comb
    reach = Fraction(d).limit_denominator(m * n)
    inside = {}
    for i in range(m + 1):
        for j in range(n + 1):
            if abs(Fraction(i, m) - Fraction(j, n)) >= reach:
                inside[i, j] = 0
            else:
                inside[i, j] = 1 if i + j == 0 else inside.get((i - 1, j), 0) + inside.get((i, j - 1), 0)
    return float(1 - Fraction(inside[m, n], comb(m + n, m)))


def test_exact_tail_by_brute_force(spark):
    rng = np.random.default_rng(1)
    cases = [(1, 1, 1.0), (1, 30, 0.5), (30, 30, 1.0)]
    while len(cases) < 40:
        m, n = (int(x) for x in rng.integers(2, 31, 2))
        cases.append((m, n, _brute_ks(rng.normal(size=m), rng.normal(size=n) + rng.random())))
    df = spark.createDataFrame([(m, n, float(d)) for m, n, d in cases], "m long, n long, d double")
    got = df.select("m", "n", "d", DR.ks_exact_tail(F.col("d"), F.col("m"), F.col("n")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - _paths_tail(r["d"], r["m"], r["n"])) < 1e-12


def test_ks_method_by_size(spark):
    def side(k, shift):
        return spark.range(k).selectExpr("cast(id as string) customer_id", f"cast(id * 1.7 + {shift} as double) x")
    small, large = DR.ks(side(20, 0), side(25, 9), ["x"]).first(), DR.ks(side(200, 0), side(250, 9), ["x"]).first()
    assert small["ks_method"] == "exact" and large["ks_method"] == "asymptotic"
    d = _brute_ks(np.arange(20) * 1.7, np.arange(25) * 1.7 + 9)
    assert abs(small["ks_pvalue"] - _paths_tail(d, 20, 25)) < 1e-6
