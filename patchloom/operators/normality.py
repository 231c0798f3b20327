"""The Shapiro-Wilk test from distributed ranks, with the published approximation of its weights and p-value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators.cumulative import running_before, value_counts
from patchloom.operators.ranktests import two_sided_p

# Rational approximation of the inverse normal distribution (relative error below 1.2e-9).
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
# Polynomials of the published test, highest power first.
LAST_WEIGHT = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
NEXT_WEIGHT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SMALL_MEAN, SMALL_WIDTH = (-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822)
LARGE_MEAN, LARGE_WIDTH = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)

#: Ranks of one value are dealt to tasks in chunks of this many.
CHUNK = 4096


def polynomial(factors: Sequence[float], x: str) -> str:
    """SQL of a polynomial, highest power first."""
    text = f"CAST({factors[0]!r} AS DOUBLE)"
    for factor in factors[1:]:
        text = f"({text} * {x} + CAST({factor!r} AS DOUBLE))"
    return text


def inverse_normal(p: str) -> str:
    """SQL of the value below which a standard normal lies with probability ``p``."""
    middle, square = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tails = [f"{polynomial(TAIL_TOP, q)} / {polynomial(TAIL_BOTTOM, q)}" for q in (low, high)]
    centre = f"{middle} * {polynomial(CENTRE_TOP, square)} / {polynomial(CENTRE_BOTTOM, square)}"
    return f"CASE WHEN {p} < {TAIL} THEN {tails[0]} WHEN {p} > 1 - {TAIL} THEN -({tails[1]}) ELSE {centre} END"


def score_of(rank: str, n: str) -> str:
    """SQL of the normal score of a rank."""
    return inverse_normal(f"((CAST({rank} AS DOUBLE) - 0.375) / (CAST({n} AS DOUBLE) + 0.25))")


def statistic_sql() -> str:
    """W from n, the sum ``mm`` of squared scores, the sum ``inner`` of score times value over the ranks 3 to n - 2, the four
    outer values x1, x2, y2, y1 (greatest) and the sum ``squares`` of squared deviations."""
    root = "(1 / sqrt(CAST(n AS DOUBLE)))"
    last = f"(CASE WHEN n = 3 THEN sqrt(CAST(0.5 AS DOUBLE)) ELSE {polynomial(LAST_WEIGHT, root)} + m1 / sqrt(mm) END)"
    next_ = f"({polynomial(NEXT_WEIGHT, root)} + m2 / sqrt(mm))"
    few = f"sqrt((mm - 2 * m1 * m1) / (1 - 2 * {last} * {last}))"
    many = f"sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * {last} * {last} - 2 * {next_} * {next_}))"
    small = f"({last} * (y1 - x1) + CASE WHEN n = 3 THEN 0 WHEN n = 4 THEN m2 * (y2 - x2) / {few} ELSE (m2 * (y2 - x2) + inner_sum) / {few} END)"
    large = f"({last} * (y1 - x1) + {next_} * (y2 - x2) + inner_sum / {many})"
    top = f"(CASE WHEN n <= 5 THEN {small} ELSE {large} END)"
    return f"CASE WHEN n >= 3 AND squares > 0 THEN least(CAST(1 AS DOUBLE), {top} * {top} / squares) END"


def deviate_sql() -> str:
    """The standard normal deviate of W for n from 4; its upper tail is p."""
    n, log = "CAST(n AS DOUBLE)", "ln(CAST(n AS DOUBLE))"
    small = f"(-ln(-2.273 + 0.459 * {n} - ln(1 - w_stat)) - {polynomial(SMALL_MEAN, n)}) / exp({polynomial(SMALL_WIDTH, n)})"
    large = f"(ln(1 - w_stat) - {polynomial(LARGE_MEAN, log)}) / exp({polynomial(LARGE_WIDTH, log)})"
    return f"CASE WHEN n < 4 OR w_stat >= 1 THEN NULL WHEN n <= 11 THEN {small} ELSE {large} END"


def upper_tail(z: Column) -> Column:
    both = two_sided_p(z) / 2
    return F.when(z >= 0, both).otherwise(1 - both)


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, w_stat, z_stat, p_value. Nulls are left out; W is null below 3 rows or where all values are equal, and p is
    null then and below 4 rows. Rows of one value take the scores of their ranks one after the other, in chunks that tasks
    share, so that a value held by a third of all rows is no single task's work. p is an approximation for 4 to 5,000 rows;
    beyond, any small departure from a normal shape is significant."""
    keys = list(keys)
    ranked = running_before(value_counts(df, keys, value), keys, ["n"])
    first, last = F.col("before_n") + 1, F.col("before_n") + F.col("n")
    chunks = ranked.select(*keys, "value", F.col("total_n").alias("size"), last.alias("end"), F.explode(F.sequence(first, last, F.lit(CHUNK))).alias("start"))
    dealt = chunks.repartition(*keys, "start")
    ranks = dealt.select(*keys, "value", "size", F.explode(F.sequence("start", F.least(F.col("end"), F.col("start") + CHUNK - 1))).alias("rank"))
    scored = ranks.withColumn("m", F.expr(score_of("rank", "size")))
    x, rank, size = F.col("value"), F.col("rank"), F.col("size")

    def at(place: Column) -> Column:
        return F.max(F.when(rank == place, x))

    sums = scored.groupBy(*keys, size.alias("n")).agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.coalesce(F.sum(F.when((rank > 2) & (rank < size - 1), F.col("m") * x)), F.lit(0.0)).alias("inner_sum"),
        at(F.lit(1)).alias("x1"),
        at(F.lit(2)).alias("x2"),
        at(size - 1).alias("y2"),
        at(size).alias("y1"),
        (F.var_pop(x) * F.count("*")).alias("squares"),
    )
    outer = sums.withColumn("m1", F.expr(score_of("n", "n"))).withColumn("m2", F.expr(score_of("(n - 1)", "n")))
    tested = outer.withColumn("w_stat", F.expr(statistic_sql())).withColumn("z_stat", F.expr(deviate_sql()))
    return tested.select(*keys, "n", "w_stat", "z_stat", upper_tail(F.col("z_stat")).alias("p_value"))
