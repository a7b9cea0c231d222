"""Reusable column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import constants as K


def lit_date(d: _dt.date | str) -> Column:
    return F.lit(d if isinstance(d, _dt.date) else _dt.date.fromisoformat(d))


def compress_date(col: Column, as_of: _dt.date, factor: int = K.TIME_COMPRESSION) -> Column:
    """Map a date d < as_of onto as_of - floor((as_of - d) / factor)."""
    days = F.datediff(lit_date(as_of), F.to_date(col))
    return F.date_sub(lit_date(as_of), F.floor(days / F.lit(factor)).cast("int"))


def tier(score: Column) -> Column:
    """Shared four-level tier for churn probability, risk and propensity."""
    return (F.when(score >= K.TIER_CRITICAL, "critical")
             .when(score >= K.TIER_HIGH, "high")
             .when(score >= K.TIER_MEDIUM, "medium")
             .otherwise("low"))


def tier_order(tier_col: Column) -> Column:
    """Dashboard order: critical, high, medium, other."""
    return (F.when(tier_col == "critical", 0).when(tier_col == "high", 1)
             .when(tier_col == "medium", 2).otherwise(3))
