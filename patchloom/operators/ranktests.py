"""Significance tests computed as distributed aggregations.

All rank tests read one table: per metric and distinct value the number of rows of each
group, with the number of rows before it. Mann-Whitney of a small group without ties has the
exact p-value, all other rank tests the asymptotic one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.cumulative import running_before


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0)))


def two_sided_p(z: Column) -> Column:
    """p of a standard normal; runs on a handful of result rows."""
    return F.pandas_udf(_normal_tails, "double")(z)


#: Size of the smaller group up to which U without ties is judged by its exact distribution.
EXACT_SIZE = 8


def u_counts(k: int, m: int) -> np.ndarray:
    """How many orders of groups of k and m values without ties give each U from 0 to k * m.

    The counts are the coefficients of the product of (1 - q^(m+i)) / (1 - q^i) for i up to k: a shifted
    difference and a running sum with step i. Whole numbers of any length.
    """
    counts = np.zeros(k * m + 1, dtype=np.int64 if math.comb(m + k, k) < 1 << 60 else object)
    counts[0] = 1
    for i in range(1, k + 1):
        if m + i < len(counts):
            counts[m + i :] = counts[m + i :] - counts[: len(counts) - m - i]
        for start in range(i):
            counts[start::i] = np.cumsum(counts[start::i])
    return counts


def _exact_tails(n_first: pd.Series, n_second: pd.Series, larger: pd.Series) -> pd.Series:
    out = []
    for a, b, u in zip(n_first, n_second, larger, strict=True):
        k, m = int(min(a, b)), int(max(a, b))
        if k < 1 or k > EXACT_SIZE or pd.isna(u):
            out.append(None)
            continue
        upper = u_counts(k, m)[int(u) :].sum()
        out.append(min(1.0, 2 * int(upper) / math.comb(m + k, k)))
    return pd.Series(out, dtype="float64")


def rank_table(df: DataFrame, keys: Sequence[str], group: str, labels: Sequence, value: str) -> DataFrame:
    """Per (keys, value): ``n_0 … n_k`` by group label, their sum ``n``, and the mid-rank."""
    member = [F.count(F.when(F.col(group) == F.lit(x), 1)).alias(f"n_{i}") for i, x in enumerate(labels)]
    kept = df.where(F.col(group).isin(*labels) & F.col(value).isNotNull())
    counts = kept.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(*member, F.count("*").alias("n"))
    ranked = running_before(counts, keys, ["n"])
    return ranked.withColumn("midrank", F.col("before_n") + (F.col("n") + 1) / F.lit(2.0))


def rank_sums(df: DataFrame, keys: Sequence[str], group: str, labels: Sequence, value: str) -> DataFrame:
    """Per key: group sizes ``size_i``, rank sums ``ranks_i``, total ``size``, tie term ``ties``."""
    table = rank_table(df, keys, group, labels, value)
    n = F.col("n").cast("double")
    parts = []
    for i in range(len(labels)):
        parts.append(F.sum(f"n_{i}").alias(f"size_{i}"))
        parts.append(F.sum(F.col("midrank") * F.col(f"n_{i}")).alias(f"ranks_{i}"))
    return table.groupBy(*keys).agg(*parts, F.sum("n").alias("size"), F.sum(n * n * n - n).alias("ties"))


def _tie_share(size: Column, ties: Column) -> Column:
    n = size.cast("double")
    return F.try_divide(ties, n * n * n - n)


def mann_whitney(
    df: DataFrame, group: str, value: str, first, second, keys: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Two-sided Mann–Whitney U of ``first`` against ``second``.

    p is exact if no values tie and a group has at most ``EXACT_SIZE``, else that of z, with tie and continuity correction."""
    for name in (group, value):
        if name not in df.columns:
            raise ValueError(f"column not found: {name}")
    sums = rank_sums(df, keys, group, [first, second], value)
    n1, n2, n = F.col("size_0").cast("double"), F.col("size_1").cast("double"), F.col("size").cast("double")
    u1 = F.col("ranks_0") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    larger = F.greatest(u1, n1 * n2 - u1)
    z = F.try_divide(larger - n1 * n2 / 2 - F.lit(0.5), F.sqrt(variance))
    stats = sums.select(
        *keys,
        F.col("size_0").alias("n_first"),
        F.col("size_1").alias("n_second"),
        u1.alias("u_stat"),
        z.alias("z_stat"),
        larger.alias("_larger"),
        (F.col("ties") == 0).alias("_free"),
    )
    p = F.least(two_sided_p(F.greatest(F.col("z_stat"), F.lit(0.0))), F.lit(1.0))
    exact = F.pandas_udf(_exact_tails, "double")("n_first", "n_second", "_larger")
    both = stats.withColumn("_exact", exact).withColumn("_asymptotic", p)
    judged = both.withColumn("p_value", F.when(F.col("_free") & F.col("_exact").isNotNull(), F.col("_exact")).otherwise(F.col("_asymptotic")))
    return judged.drop("_larger", "_free", "_exact", "_asymptotic").withColumn("significant", F.col("p_value") < F.lit(alpha))


def kruskal(df: DataFrame, group: str, value: str, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Kruskal–Wallis H over the labelled groups, tie corrected. For three groups the
    chi-square tail is exp(-H/2); for two it is that of z = sqrt(H)."""
    sums = rank_sums(df, keys, group, labels, value)
    n = F.col("size").cast("double")
    spread = sum(
        (F.try_divide(F.col(f"ranks_{i}") * F.col(f"ranks_{i}"), F.col(f"size_{i}")) for i in range(len(labels))),
        F.lit(0.0),
    )
    h = F.try_divide(
        F.lit(12.0) / (n * (n + 1)) * spread - F.lit(3.0) * (n + 1), 1 - _tie_share(F.col("size"), F.col("ties"))
    )
    out = sums.select("*", h.alias("h_stat"))
    return out.withColumn("p_value", _chi2_tail(F.col("h_stat"), len(labels) - 1))


def _chi2_tail(x: Column, dof: int) -> Column:
    """Upper tail of chi-square by its finite sum (even) or from the normal tail (odd)."""
    if dof % 2 == 0:
        terms = sum((F.pow(x / 2, F.lit(float(i))) / math.factorial(i) for i in range(dof // 2)), F.lit(0.0))
        return F.exp(-x / 2) * terms
    tail = two_sided_p(F.sqrt(F.greatest(x, F.lit(0.0))))
    for i in range(1, (dof + 1) // 2):
        tail = tail + F.pow(x / 2, F.lit(i - 0.5)) * F.exp(-x / 2) / F.lit(math.gamma(i + 0.5))
    return tail


def dunn_holm(
    df: DataFrame, group: str, value: str, labels: Sequence, keys: Sequence[str] = (), alpha: float | None = 0.05
) -> DataFrame:
    """Dunn's pairwise comparisons with Holm's correction, for keys whose Kruskal–Wallis
    p is below ``alpha`` (None: always). One row per pair of labels; the pairs are written
    out from the label list, no join is needed."""
    tested = kruskal(df, group, value, labels, keys)
    if alpha is not None:
        tested = tested.where(F.col("p_value") < F.lit(alpha))
    n = F.col("size").cast("double")
    base = n * (n + 1) / 12 - F.try_divide(F.col("ties"), 12 * (n - 1))
    pairs = []
    for i in range(len(labels)):
        for j in range(i + 1, len(labels)):
            gap = F.try_divide(F.col(f"ranks_{i}"), F.col(f"size_{i}")) - F.try_divide(F.col(f"ranks_{j}"), F.col(f"size_{j}"))
            width = F.sqrt(base * (F.try_divide(F.lit(1.0), F.col(f"size_{i}")) + F.try_divide(F.lit(1.0), F.col(f"size_{j}"))))
            pairs.append(
                F.struct(
                    F.lit(labels[i]).cast("string").alias("first"),
                    F.lit(labels[j]).cast("string").alias("second"),
                    F.try_divide(gap, width).alias("z_stat"),
                )
            )
    rows = tested.select(*keys, F.inline(F.array(*pairs))).withColumn("p_raw", two_sided_p(F.col("z_stat")))
    rows = rows.withColumn("_key", F.lit(1)) if not keys else rows
    part = list(keys) or ["_key"]
    order = Window.partitionBy(*part).orderBy("p_raw", "first", "second")
    step = F.col("p_raw") * (F.lit(len(pairs)) - F.row_number().over(order) + 1)
    held = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_step", step).withColumn("p_holm", F.least(held, F.lit(1.0)))
    return out.select(*keys, "first", "second", "z_stat", "p_raw", "p_holm")


def two_proportions(hits: Column, trials: Column, hits2: Column, trials2: Column) -> Column:
    """z of two proportions with pooled variance."""
    pooled = F.try_divide((hits + hits2).cast("double"), trials + trials2)
    width = F.sqrt(
        pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), trials) + F.try_divide(F.lit(1.0), trials2))
    )
    gap = F.try_divide(hits.cast("double"), trials) - F.try_divide(hits2.cast("double"), trials2)
    return F.try_divide(gap, width)


def proportion_test(df: DataFrame, group: str, first, second, hit: Column, unit: str) -> DataFrame:
    """Compare the share of distinct ``unit`` with ``hit`` between two groups."""

    def side(label, only_hits: bool) -> Column:
        chosen = (F.col(group) == F.lit(label)) & hit if only_hits else F.col(group) == F.lit(label)
        return F.count_distinct(F.when(chosen, F.col(unit)))

    counts = df.agg(
        side(first, True).alias("hits_first"),
        side(first, False).alias("trials_first"),
        side(second, True).alias("hits_second"),
        side(second, False).alias("trials_second"),
    )
    z = two_proportions(F.col("hits_first"), F.col("trials_first"), F.col("hits_second"), F.col("trials_second"))
    return counts.withColumn("z_stat", z).withColumn("p_value", two_sided_p(F.col("z_stat")))


def jarque_bera(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Normality statistic from skewness and excess kurtosis; p from chi-square with 2 degrees."""
    kept = df.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    stats = kept.groupBy(*keys).agg(
        F.count("*").alias("count"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis")
    )
    jb = F.col("count") / 6.0 * (F.pow("skewness", F.lit(2.0)) + F.pow("kurtosis", F.lit(2.0)) / 4.0)
    return stats.withColumn("jb_stat", jb).withColumn("p_value", F.exp(-F.col("jb_stat") / 2))
