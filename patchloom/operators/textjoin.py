"""Joining the texts (or lists) of a key into values of bounded size.

A key may hold a large part of all rows, and one value cannot grow without end. One rule
holds for every key: its rows, in ``order``, are cut into contiguous chunks by their running
size, and the result has one row per key and chunk (``part``, ascending from 0). Chunks put
together in the order of ``part`` are the whole key. A chunk ends with the row that reaches
the limit; after a row above the limit, numbers are left out.

Keys are dealt to buckets by hash. Most buckets do not reach the limit, so none of their keys
is cut: their rows are grouped in one shuffle. Only keys of the other buckets are ranged. Their
running size needs no window over a whole key: rows are range-partitioned by key and
order, so a hot key spreads over many ranges; totals per range give the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.session import materialize

MAX_CHARS = 64 * 1024 * 1024
BUCKETS = 16_384


def _grouped(
    df: DataFrame, keys: list[str], order: Sequence[str], size: Column, limit: int, distinct: bool, join: Callable[..., DataFrame]
) -> DataFrame:
    """``join(rows, *keys, "part")`` of all rows. They are written out once and lie by key only where they are joined."""
    rows = materialize(df.withColumn("_size", size), "unjoined")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    totals = rows.groupBy(bucket.alias("bucket")).agg(F.sum("_size").alias("total"))
    large = [r.bucket for r in totals.where(F.col("total") >= limit).collect()]
    small = rows.where(~bucket.isin(large)) if large else rows
    small = small.drop("_size")
    if distinct:
        small = small.repartition(*keys).distinct()
    whole = join(small, *keys).withColumn("part", F.lit(0))
    if not large:
        return whole
    cut = rows.where(bucket.isin(large)).drop("_size")
    parted = _chunked(cut.distinct() if distinct else cut, keys, order, size, limit)
    return join(parted, *keys, "part").unionByName(whole)


def _chunked(df: DataFrame, keys: list[str], order: Sequence[str], size: Column, limit: int) -> DataFrame:
    """Adds ``part``. The ranges are written out, as another run could cut them elsewhere."""
    ranged = df.withColumn("_size", size).repartitionByRange(*keys, *order)
    rows = materialize(ranged.withColumn("_range", F.spark_partition_id()), "chunks")
    totals = rows.groupBy(*keys, "_range").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_at"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    part = F.floor((F.col("_offset") + F.col("_local")) / F.lit(limit)).cast("int")
    return local.join(offsets, same).select(*df.columns, part.alias("part"))


def join_texts(
    df: DataFrame,
    keys: Sequence[str],
    texts: dict[str, str],
    order: Sequence[str],
    separator: str = " ",
    max_chars: int = MAX_CHARS,
    weight: Column | None = None,
    distinct: bool = False,
) -> DataFrame:
    """``texts`` maps output column to input column; ``rows`` counts the rows of a chunk.
    Null texts are skipped, null keys left out. Rows equal in ``order`` go by their texts.
    ``weight`` is the size of a row, if it stands for more than its texts. With ``distinct`` equal rows count once, as after
    ``df.distinct()`` but without a shuffle of its own."""
    keys = list(keys)
    kept = df
    for name in keys:
        kept = kept.where(F.col(name).isNotNull())
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts.values()), F.lit(1)).cast("long")
    order = list(dict.fromkeys([*order, *texts.values()]))
    by = ", ".join(f"`{c}`" for c in order)
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    joined = [
        F.expr(f"listagg(`{src}`, '{quoted}') WITHIN GROUP (ORDER BY {by})").alias(out) for out, src in texts.items()
    ]

    def join(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(*joined, F.count(F.lit(1)).alias("rows"))

    size = size if weight is None else F.greatest(size, weight)
    return _grouped(kept, keys, order, size, max_chars, distinct, join).select(*keys, "part", *texts, "rows")


def join_lists(
    df: DataFrame,
    keys: Sequence[str],
    lists: Sequence[str],
    order: Sequence[str],
    max_items: int = 1_000_000,
) -> DataFrame:
    """Concatenated array columns per key and chunk, repeats kept, in ``order`` (rows equal in it go by their lists)."""
    keys = list(keys)
    size = sum((F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in lists), F.lit(1)).cast("long")
    order = list(dict.fromkeys([*order, *lists]))
    sorted_rows = F.array_sort(F.collect_list(F.struct(*order)))

    def join(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(sorted_rows.alias("_rows"))

    grouped = _grouped(df, keys, order, size, max_items, False, join)
    return grouped.select(*keys, "part", *[F.flatten(F.col(f"_rows.{c}")).alias(c) for c in lists])
