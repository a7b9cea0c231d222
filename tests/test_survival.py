from pyspark.sql import functions as F

from tidemark.operators import survival as SV


def test_km_hand_example(spark):
    # durations 1,2,2,3,4 with events 1,1,0,1,0 -> S(1)=.8, S(2)=.6, S(3)=.3
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 1), (4, 0)], "duration_days int, event int")
    got = {r["t"]: r["survival"] for r in SV.km_curve(df).collect()}
    assert abs(got[1] - 0.8) < 1e-9 and abs(got[2] - 0.6) < 1e-9 and abs(got[3] - 0.3) < 1e-9
    assert abs(got[4] - 0.3) < 1e-9


def test_logrank_identical_groups_is_zero(spark):
    rows = [(d, e, g) for g in (True, False) for d, e in [(1, 1), (2, 0), (3, 1), (5, 1)]]
    df = spark.createDataFrame(rows, "duration_days int, event int, g boolean")
    r = SV.logrank_two(df, F.col("g")).collect()[0]
    assert abs(r["chi2"]) < 1e-12
