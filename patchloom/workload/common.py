"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, as the oracle statements give them."""
    return df.select(*[F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def describe_sql(keys: str, value: str, source: str) -> str:
    """count, mean, std, min, quartiles, max per key as SQL."""
    lead = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}count({value}) AS count, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std,
      round(CAST(min({value}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({value} AS DOUBLE), 0.25), 6) AS p25,
      round(quantile_cont(CAST({value} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({value} AS DOUBLE), 0.75), 6) AS p75,
      round(CAST(max({value}) AS DOUBLE), 6) AS max FROM {source} WHERE {value} IS NOT NULL {tail}"""


def two_sided_sql(z: str) -> str:
    """p of a standard normal as SQL: the series of the distribution around 0, its terms nested; 0 to six digits beyond 8."""
    nested = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(200, 0, -1), lambda j: (2 * j + 1)::DOUBLE)), lambda acc, d: 1 + ({z}) ** 2 / d * acc)"
    return f"CASE WHEN abs({z}) > 8 THEN 0.0 ELSE greatest(0.0, 1 - 2 * abs({z}) * exp(-(({z}) ** 2) / 2) / sqrt(2 * pi()) * {nested}) END"


def mann_whitney_sql(keys: str, group: str, value: str, first: str, second: str, source: str) -> str:
    """U, z and the asymptotic p of two groups as SQL over ``source``; ``keys`` is a column list or ''."""
    lead, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    tail = f"GROUP BY {keys}" if keys else ""
    return f"""WITH kept AS (SELECT {lead}{group} AS g, CAST({value} AS DOUBLE) AS v FROM {source}
        WHERE {group} IN ({first}, {second}) AND {value} IS NOT NULL),
      ranked AS (SELECT *, rank() OVER ({part} ORDER BY v) + (count(*) OVER (PARTITION BY {lead}v) - 1) / 2.0 AS mr,
        count(*) OVER (PARTITION BY {lead}v) AS t FROM kept),
      sums AS (SELECT {lead}count(*) FILTER (g = {first}) AS n1, count(*) FILTER (g = {second}) AS n2,
        count(*) AS n, sum(mr) FILTER (g = {first}) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM ranked {tail}),
      u AS (SELECT *, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS u1 FROM sums),
      zs AS (SELECT *, (greatest(u1, CAST(n1 AS DOUBLE) * n2 - u1) - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5)
        / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n + 1 - ties / (CAST(n AS DOUBLE) * (n - 1)))) AS z FROM u),
      ps AS (SELECT *, {two_sided_sql("greatest(z, 0)")} AS p FROM zs)
    SELECT {lead}n1 AS n_first, n2 AS n_second, round(u1, 6) AS u_stat, round(z, 6) AS z_stat, round(p, 6) AS p_value, p < 0.05 AS significant FROM ps"""
