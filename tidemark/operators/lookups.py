"""Key lookups re-aimed as whole-table jobs (keys arrive as a DataFrame)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import constants as K
from tidemark.functions.columns import lit_date


def customers_by_ids(customers: DataFrame, keys: DataFrame) -> DataFrame:
    """Fetch customers for a key table (semi join; the key table may be large)."""
    return customers.join(keys.select("customer_id").distinct(), "customer_id", "left_semi")


def active_by_mrr(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("churn_date").isNull()).orderBy(F.col("mrr").desc(), F.col("customer_id"))


def seeded_hash(col: str, seed: int | str = K.RANDOM_SEED):
    """md5 of seed and value: the same order in every engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(col)).cast("binary"))


def sample_n(customers: DataFrame, n: int = 100, seed: int = K.RANDOM_SEED) -> DataFrame:
    """Repeatable sample of n rows: smallest seeded hash wins.

    Independent of partitioning and file order; top-n by hash is a
    TakeOrderedAndProject, so no global sort of the table."""
    return customers.orderBy(seeded_hash("customer_id", seed), F.col("customer_id")).limit(max(0, n))


def events_since(events: DataFrame, since: _dt.datetime, ts_col: str = "timestamp") -> DataFrame:
    return events.where(F.col(ts_col) >= F.lit(since)).orderBy(F.col("customer_id"), F.col(ts_col).desc())


def event_count_n_days(customers: DataFrame, events: DataFrame, as_of: _dt.datetime, n_days: int,
                       ts_col: str = "timestamp") -> DataFrame:
    """Events in the last n days on the timestamp clock, for every customer at once."""
    since = F.lit(as_of) - F.expr(f"INTERVAL {int(n_days)} DAYS")
    counts = events.where(F.col(ts_col) >= since).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return customers.select("customer_id").join(counts, "customer_id", "left") \
        .select("customer_id", F.coalesce("n", F.lit(0)).alias(f"events_last_{n_days}d"))


def open_opportunities(opps: DataFrame) -> DataFrame:
    return opps.where(~F.col("stage").isin(*K.CLOSED_STAGES))


def row_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table; the counts run as one job over a union."""
    from functools import reduce
    parts = [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))


def as_of_ts(d: _dt.date) -> _dt.datetime:
    return _dt.datetime(d.year, d.month, d.day)

