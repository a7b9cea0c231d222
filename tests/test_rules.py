"""Rule checks with the hand-worked values of the original's unit tests."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.columns import tier
from tidemark.operators import risk as R
from tidemark.operators.features import _recency


def test_tier(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.8,)], "p double")
    got = [r[0] for r in df.select(tier(F.col("p"))).collect()]
    assert got == ["low", "medium", "high", "critical"]


def test_composite(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (1.0, 1.0, 10), (0.5, 0.5, 5), (0.5, 0.5, 100)],
                               "d double, g double, f int")
    got = [r[0] for r in df.select(R.composite_score(F.col("d"), F.col("g"), F.col("f"))).collect()]
    assert got[0] == 0.0 and got[1] == 1.0 and got[2] == got[3]


def test_recency_rule(spark):
    df = spark.createDataFrame([(0, None, 2), (42, 3, 90), (0, 999, 5)],
                               "total_events int, days_since_last_event int, tenure int")
    got = [r[0] for r in df.select(_recency(F.col("tenure"))).collect()]
    assert got == [2, 3, 5]


def test_uplift(spark):
    df = spark.createDataFrame([("starter", 1000.0, 0.5), ("growth", 5000.0, 0.8), ("enterprise", 20000.0, 0.6),
                                ("custom", 1000.0, 0.9), ("free", 0.0, 0.5)], "plan string, mrr double, p double")
    got = [r[0] for r in df.select(R.expected_uplift(F.col("plan"), F.col("mrr"), F.col("p"))).collect()]
    assert got == [12000.0, 192000.0, 28800.0, 0.0, 3000.0]


def test_next_tier_and_target(spark):
    df = spark.createDataFrame([("free", 0.8, 4800.0), ("growth", 0.6, 20000.0), ("growth", 0.4, 20000.0)],
                               "plan string, p double, u double")
    got = df.select(R.next_tier(F.col("plan")), R.high_value_target(F.col("plan"), F.col("p"), F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("starter", True), ("enterprise", True), ("enterprise", False)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=1, max_size=20))
def test_every_probability_has_a_tier(spark, ps):
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(tier(F.col("p"))).collect()]
    assert all(t in ("low", "medium", "high", "critical") for t in got)


def test_uplift_non_negative(spark):
    rows = [(plan, m, p) for plan in ("free", "starter", "growth", "enterprise") for m in (0.0, 10.0, 9000.0)
            for p in (0.0, 0.3, 1.0)]
    df = spark.createDataFrame(rows, "plan string, mrr double, p double")
    assert df.select(R.expected_uplift(F.col("plan"), F.col("mrr"), F.col("p")).alias("u")).where("u < 0").count() == 0


def test_compress_date(spark):
    from tidemark.functions.columns import compress_date
    as_of = dt.date(2001, 8, 1)
    df = spark.createDataFrame([(dt.date(2001, 7, 31),), (dt.date(2001, 7, 24),), (dt.date(2001, 7, 1),)], "d date")
    got = [r[0] for r in df.select(compress_date(F.col("d"), as_of)).collect()]
    assert got == [as_of, dt.date(2001, 7, 31), dt.date(2001, 7, 29)]


def test_entry_imports_without_session():
    """oracle_sql()/queries() must not need a SparkContext (no Column at import)."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "assert set(E.oracle_sql()) <= set(E.queries())") % __import__("os").path.dirname(
        __import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/tmp")
