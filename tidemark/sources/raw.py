"""Raw-table contracts: fixed schemas, typed CSV loading, NOT NULL enforcement.

Spark readers do not enforce nullability, so ``enforce_not_null`` checks all
declared NOT NULL columns of a table in one aggregation pass and raises.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, TS, I, FL, B = T.StringType(), T.DateType(), T.TimestampType(), T.IntegerType(), T.FloatType(), T.BooleanType()


def _f(name, typ, nullable=False):
    return T.StructField(name, typ, nullable)


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": T.StructType([_f("customer_id", S), _f("industry", S), _f("plan_tier", S), _f("signup_date", D),
                               _f("mrr", T.DecimalType(10, 2)), _f("churn_date", D, True),
                               _f("upgrade_date", D, True)]),
    "usage_events": T.StructType([_f("event_id", S), _f("customer_id", S), _f("timestamp", TS), _f("event_type", S),
                                  _f("feature_adoption_score", FL)]),
    "support_tickets": T.StructType([_f("ticket_id", S), _f("customer_id", S), _f("created_date", D),
                                     _f("priority", S), _f("resolution_time", I, True), _f("topic", S)]),
    "gtm_opportunities": T.StructType([_f("opp_id", S), _f("customer_id", S), _f("stage", S), _f("close_date", D),
                                       _f("amount", T.DecimalType(12, 2)), _f("sales_owner", S),
                                       _f("opportunity_type", S)]),
    "risk_signals": T.StructType([_f("customer_id", S), _f("compliance_gap_score", FL),
                                  _f("vendor_risk_flags", I)]),
    "expansion_outreach_log": T.StructType([_f("outreach_id", S), _f("customer_id", S), _f("contacted_date", D),
                                            _f("propensity_at_outreach", FL), _f("outreach_channel", S),
                                            _f("outcome", S, True)]),
}


class NotNullViolation(ValueError):
    pass


def enforce_not_null(name: str, df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    schema = schema or RAW_SCHEMAS[name]
    cols = [f.name for f in schema.fields if not f.nullable and f.name in df.columns]
    if not cols:
        return df
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise NotNullViolation(f"{name}: NULL in NOT NULL columns {bad}")
    return df


def load_csv_tables(spark: SparkSession, directory: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Load headered CSVs (<table>.csv) with the fixed schemas; empty string -> NULL;
    a missing file is an error."""
    out = {}
    for name in tables or list(RAW_SCHEMAS):
        path = os.path.join(directory, f"{name}.csv")
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            raise FileNotFoundError(path)
        df = (spark.read.schema(RAW_SCHEMAS[name]).option("header", True).option("nullValue", "")
              .option("mode", "FAILFAST").csv(path))
        out[name] = enforce_not_null(name, df)
    return out


def write_tables(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet") -> None:
    """Replace existing tables (overwrite), one folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(os.path.join(directory, name))
