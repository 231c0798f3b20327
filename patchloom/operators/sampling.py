"""Reproducible samples: rows are ranked by a hash of their key and a seed.

A fixed-size sample is a distributed top-n over the rows that counts per hash prefix leave. A fraction needs the row count first: counts
per hash prefix (65,536 at most per stratum) locate the cut, and only rows of the prefixes
that reach it are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 4  # hex digits


def hash_order(key: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def lowest_hashes(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """The rows, with their hash ``_h``, of the hash prefixes that hold the ``n`` least hashes: little more than n rows of
    all tasks together, where a top-n alone takes n rows of every task. Counts per prefix (65,536 at most) tell the last one."""
    hashed = df.withColumn("_h", hash_order(key, seed))
    prefix, before = F.substring("_h", 1, PREFIX), 0
    for r in sorted(hashed.groupBy(prefix.alias("p")).count().collect()):
        before += r[1]
        if before >= n:
            return hashed.where(prefix <= r.p)
    return hashed


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows (all when fewer), chosen by key hash. ``key`` identifies a row."""
    return lowest_hashes(df, n, key, seed).orderBy("_h", *key).limit(n).drop("_h")


def sample_n_per_group(df: DataFrame, group: str, sizes: dict, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A fixed number of rows for each listed group; other groups are left out."""
    out = None
    for label, n in sizes.items():
        part = sample_n(df.where(F.col(group) == F.lit(label)), n, key, seed)
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(
    df: DataFrame, fraction: float, key: Sequence[str], strata: Sequence[str], seed: int, only_kept: bool
) -> DataFrame:
    """Adds the ``_rank`` of a row within its stratum and the ``_quota`` of the stratum."""
    rows = df.withColumn("_h", hash_order(key, seed)).withColumn("_p", F.substring("_h", 1, PREFIX))
    strata = list(strata)
    if not strata:
        rows, strata = rows.withColumn("_all", F.lit(1)), ["_all"]
    for name in strata:
        rows = rows.where(F.col(name).isNotNull())
    counts = rows.groupBy(*strata, "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*strata).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy(*strata))
    cuts = counts.select(
        *strata,
        "_p",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.bround(total * F.lit(float(fraction)), 0).cast("long").alias("_quota"),
    )
    if only_kept:
        cuts = cuts.where(F.col("_before") < F.col("_quota"))
    if strata == ["_all"]:
        cuts = F.broadcast(cuts)  # one row per prefix: the rows to be ranked are found without a shuffle of all
    inside = Window.partitionBy(*strata, "_p").orderBy("_h", *key)
    return rows.join(cuts, on=[*strata, "_p"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside))


def sample_fraction(
    df: DataFrame, fraction: float, key: Sequence[str], strata: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Round-half-even(fraction × rows) rows, per stratum when given. ``key`` identifies a row."""
    ranked = _ranked(df, fraction, key, strata, seed, only_kept=True)
    return ranked.where(F.col("_rank") <= F.col("_quota")).select(*df.columns)


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: per label the share of rows with the smallest key hash."""
    ranked = _ranked(df, test_share, key, [label], seed, only_kept=False)
    return ranked.select(*df.columns, (F.col("_rank") <= F.col("_quota")).cast("int").alias("is_test"))
