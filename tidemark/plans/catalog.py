"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver's tables (through the warehouse) so its work
grows with them. Outputs are normalised at the boundary to string, bigint,
double, date, timestamp and boolean so they compare cleanly with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import constants as K
from tidemark.plans.warehouse import warehouse
from tidemark.session import apply_query_settings, bound_broadcasts

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def normalise(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        t = f.dataType
        c = F.col(f"`{f.name}`")
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_query_settings(spark)
            bound_broadcasts(spark)
            return normalise(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


def wh(spark: SparkSession, sf_dir: str):
    return warehouse(spark, sf_dir, K.ORDERS_AS_OF)


def _load_all() -> None:
    # importing the modules registers their queries
    from tidemark.plans import queries_analysis, queries_core, queries_models, queries_text  # noqa: F401


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from tidemark.plans.oracle_types import wrap
    _load_all()
    return {name: wrap(name, sql) for name, sql in ORACLE.items()}
