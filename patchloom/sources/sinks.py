"""Writers and the keyed, resumable append."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.session import materialize
from patchloom.sources.readers import format_of

DETAIL_KEY = ("pr_id", "sha", "file")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, CSV with header, or JSON Lines, by suffix."""
    kind = format_of(path)
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.csv(
            path,
            header=True,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    else:
        writer.json(path, ignoreNullFields=False)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of the path knows it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf).exists(target)


def existing_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, or None when nothing was written there yet."""
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder without data files
            return None
        raise


def remaining(work: DataFrame, done: DataFrame | None, key: str = "pr_id") -> DataFrame:
    """Work whose key is not in the output yet; all of it without an output or without its key column."""
    if done is None or key not in done.columns:
        return work
    return work.join(done.select(key), on=key, how="left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The smallest row per key by ``order`` then all other columns.

    Combined before the shuffle, so a key with very many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


@dataclass(frozen=True)
class UpsertCounts:
    incoming: int
    added: int

    @property
    def duplicates(self) -> int:
        return self.incoming - self.added


BUCKETS = 64


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(f"bucket_{buckets}", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``upsert_append`` without its bucket column."""
    df = spark.read.parquet(path)
    return df.drop(*[c for c in df.columns if c.startswith("bucket_")])


def touched_buckets(batch: DataFrame, buckets: int) -> list[int]:
    """Buckets that occur in the batch: at most ``buckets`` numbers, whatever its size."""
    return sorted(r[0] for r in batch.select(f"bucket_{buckets}").distinct().collect())


def rows_in(existing: DataFrame, numbers: Sequence[int], buckets: int) -> DataFrame:
    """Rows of the table in these buckets; others are pruned by their folder."""
    column = f"bucket_{buckets}"
    if column not in existing.columns:
        raise ValueError(f"the table is not divided by {column}; give the number of buckets it was written with")
    return existing.where(F.col(column).isin(list(numbers)))


def touched_rows(existing: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Rows of the table in the buckets that occur in the batch."""
    return rows_in(existing, touched_buckets(batch, buckets), buckets)


# Parts of a folder in one append: a first key with very many rows is spread over them.
FOLDER_PARTS = 16


def unseen_rows(incoming: DataFrame, existing: DataFrame | None, keys: Sequence[str], buckets: int) -> DataFrame:
    """The least row of each key that ``existing`` lacks, with its bucket, dealt for ``partitionBy`` of the bucket.

    One shuffle does all of it: rows and the keys of the table meet by bucket and part of the bucket, so that neither
    the unique rows nor the new ones are shuffled or written a second time."""
    column = f"bucket_{buckets}"
    named = [F.col(k) for k in keys]
    row = F.struct(F.lit(0).alias("_first"), *[F.col(c) for c in incoming.columns if c not in (*keys, column)])
    rows = _bucketed(incoming, keys[0], buckets).select(column, *named, row.alias("_row"), F.lit(False).alias("_held"))
    if existing is not None:
        none = F.lit(None).cast(rows.schema["_row"].dataType)
        rows = rows.union(existing.select(column, *named, none.alias("_row"), F.lit(True).alias("_held")))
    part = F.pmod(F.xxhash64(F.lit("part"), *named), F.lit(FOLDER_PARTS)).alias("_part")
    dealt = rows.select("*", part).repartition(column, "_part")
    least = dealt.groupBy(column, "_part", *keys).agg(F.min("_row").alias("_row"), F.max("_held").alias("_held"))
    kinds = {f.name: f.dataType for f in incoming.schema}
    out = [F.col(c).cast(kinds[c]).alias(c) if c in keys else F.col(f"_row.`{c}`") for c in incoming.columns if c != column]
    return least.where(~F.col("_held")).select(*out, column)


def upsert_append(
    spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str] = DETAIL_KEY, buckets: int = BUCKETS
) -> int:
    """Append only rows with unseen keys and return their number.

    Since existing rows win, nothing already written is rewritten, and a second run with the
    same rows adds none. The table is divided into ``buckets`` folders by a hash of the first
    key; a batch reads only the key columns of the folders it touches. Within a folder rows
    are spread anew, so a first key with very many rows makes several files. Once there is a
    table, incoming rows are read twice: the first key for the folders, then whole.
    """
    existing = existing_table(spark, path)
    if existing is None:
        numbers, held, before = None, None, 0
    else:
        numbers = touched_buckets(_bucketed(incoming, keys[0], buckets), buckets)
        held = rows_in(existing, numbers, buckets)
        before = held.count()
    # No Observation here: a session that has used one cannot score models afterwards.
    unseen_rows(incoming, held, keys, buckets).write.mode("append").partitionBy(f"bucket_{buckets}").parquet(path)
    written = existing_table(spark, path)
    if written is None:
        return 0
    return (written if numbers is None else rows_in(written, numbers, buckets)).count() - before


def upsert_counted(
    spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str] = DETAIL_KEY, buckets: int = BUCKETS
) -> UpsertCounts:
    """As ``upsert_append``, and counts rows given and rows added."""
    given = materialize(incoming, "incoming")
    added = upsert_append(spark, given, path, keys, buckets)
    return UpsertCounts(incoming=given.count(), added=added)
