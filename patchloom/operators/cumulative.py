"""Running totals over ordered values without a single-task window, and what follows
from them: exact percentiles, describe tables, mid-ranks.

Rows are first reduced to one per distinct value (map-side combined, so copies of a hot
value collapse before the shuffle). Cut points taken from the distinct values of a key then
split it into buckets of about even size, however close the values lie: totals per bucket
give the offset of a bucket, and a window inside one bucket gives the rest. The only window
over a whole key runs on the bucket totals, of which there are ``BUCKETS`` at most. Results
are exact wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.session import materialize

BUCKETS = 256  # of the distinct values of a key
RESOLUTION = 1024.0  # buckets per unit near 1; below 1.5 million buckets over all doubles
QUARTILES = (0.25, 0.5, 0.75)


def order_bucket(value: Column, resolution: float = RESOLUTION) -> Column:
    """A monotone function of a number with a bounded number of results."""
    size = F.floor(F.log1p(F.abs(value) * F.lit(resolution)) * F.lit(resolution))
    return F.when(value < 0, -size).otherwise(size)


def cut_points(counts: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Per key ``_cuts``: at most ``buckets`` - 1 values that divide its distinct values about evenly."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = F.array_distinct(F.percentile_approx(value, shares, 20 * buckets))
    return counts.groupBy(*keys).agg(cuts.alias("_cuts"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``n`` rows per distinct (keys, value); null keys and null values are left out."""
    kept = df
    for name in [*keys, value]:
        kept = kept.where(F.col(name).isNotNull())
    return kept.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def running_before(counts: DataFrame, keys: Sequence[str], weights: Sequence[str], value: str = "value") -> DataFrame:
    """Adds ``before_<w>`` (sum of w over smaller values of the key) and ``total_<w>``.

    ``counts`` holds one row per (keys, value). It is written to the scratch folder first: cut points, totals, the
    windows and the join all read it, and what lies above it runs once.
    """
    keys, rows = list(keys), materialize(counts, "counts")
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    below = F.filter("_cuts", lambda cut: cut < F.col(value))
    rows = materialize(rows.join(cut_points(rows, keys, value), on=keys, how="inner").withColumn("_bucket", F.size(below)).drop("_cuts"), "bucketed")
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_l_{w}") for w in weights])
    joined = local.join(offsets, on=[*keys, "_bucket"], how="inner")
    return joined.select(
        *counts.columns,
        *[(F.col(f"_o_{w}") + F.col(f"_l_{w}")).alias(f"before_{w}") for w in weights],
        *[f"total_{w}" for w in weights],
    )


def _at(position: Column) -> Column:
    """Aggregate: the value at a 0-based position of the sorted rows."""
    hit = (F.col("before_n") <= position) & (position < F.col("before_n") + F.col("n"))
    return F.max(F.when(hit, F.col("value")))


def _quantile(prob: float) -> Column:
    """Aggregate: quantile with linear interpolation between neighbours."""
    place = (F.col("total_n") - 1) * F.lit(float(prob))
    low, high = _at(F.floor(place)), _at(F.ceil(place))
    share = F.max(place - F.floor(place))
    return low + (high - low) * share


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles per key; ``probs`` maps output column to probability."""
    ranked = running_before(value_counts(df, keys, value), keys, ["n"])
    return ranked.groupBy(*keys).agg(*[_quantile(p).alias(name) for name, p in probs.items()])


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, std (n-1), min, p25, p50, p75, max of a column per key, all exact."""
    counts = value_counts(df, keys, value).withColumn("v", F.col("value") * F.col("n"))
    ranked = running_before(counts, keys, ["n", "v"])
    mean = F.col("total_v") / F.col("total_n")
    squares = F.sum(F.col("n") * (F.col("value") - mean) * (F.col("value") - mean))
    size = F.sum("n")
    return ranked.groupBy(*keys).agg(
        size.alias("count"),
        F.max(mean).alias("mean"),
        F.sqrt(F.try_divide(squares, size - 1)).alias("std"),
        F.min("value").alias("min"),
        *[_quantile(p).alias(f"p{int(p * 100)}") for p in QUARTILES],
        F.max("value").alias("max"),
    )


def stack_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Measures as rows (keys, metric, value), so one job serves several measures."""
    cols = [F.col(m).cast("double").alias(m) for m in metrics]
    return df.select(*keys, *cols).unpivot(list(keys), list(metrics), "metric", "value")
