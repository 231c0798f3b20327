"""Data checks: violation tables that scale, and assertions built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataCheckError(ValueError):
    """A data check failed."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of nulls per column."""
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: share of nulls per column."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns or df.columns])


def _fail_on_rows(violations: DataFrame, message: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise DataCheckError(f"{message}: {[r.asDict() for r in found]}")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    _fail_on_rows(repeated_keys(df, keys), f"key {list(keys)} repeats")
    return df


def assert_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    _fail_on_rows(df.where(cond).select(*columns), f"null in {list(columns)}")
    return df


def assert_bound(df: DataFrame, column: str, limit) -> DataFrame:
    """Every value of the column lies strictly below ``limit``."""
    _fail_on_rows(df.where(F.col(column) >= F.lit(limit)).select(column), f"{column} reaches {limit}")
    return df


def assert_row_preserving(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join keeps the row count when the right side has unique keys."""
    return assert_unique(dimension.where(F.col(keys[0]).isNotNull()), keys)
