"""Sets of names, melting and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(a: Column, b: Column) -> Column:
    """Elements of ``a`` not in ``b``, repeats kept. ``b`` is computed once per row, not per element."""
    bound = F.transform(F.array(b), lambda other: F.filter(a, lambda x: ~F.array_contains(other, x)))
    return F.get(bound, F.lit(0))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def explode_names(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per list element; empty and null lists give none."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(name))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """``<column>_<category>`` INT columns for the listed categories in place of the column."""
    flags = [F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)).alias(f"{column}_{c}") for c in categories]
    return df.select(*[c for c in df.columns if c != column], *flags)


def one_hot_vector(df: DataFrame, column: str) -> DataFrame:
    """``<column>_vector`` in place of the column: a sparse vector with one place per value, by falling frequency, for any
    number of values; null gives a vector of zeros."""
    index = StringIndexer(inputCol=column, outputCol=f"{column}_index", handleInvalid="keep").fit(df)
    encoder = OneHotEncoder(inputCol=f"{column}_index", outputCol=f"{column}_vector", dropLast=True)
    indexed = index.transform(df)
    return encoder.fit(indexed).transform(indexed).drop(column, f"{column}_index")
