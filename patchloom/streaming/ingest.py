"""Resumable ingest of landed payload files.

Each run takes what arrived since the last one, flattens it and appends rows with unseen
keys. The checkpoint records finished files; a batch repeated after a failure adds nothing,
because its keys are already in the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from patchloom.session import settings
from patchloom.sources.sinks import DETAIL_KEY, upsert_append
from patchloom.sources.snapshots import SnapshotTable


def ingest_available(
    spark: SparkSession,
    source: DataFrame,
    output: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = DETAIL_KEY,
    atomic: bool = False,
) -> None:
    """Drain a streaming file source into the table at ``output`` and stop.

    With ``atomic`` the output is a ``SnapshotTable``: a batch becomes visible whole, and one repeated after a failure is
    known by its number (and the checkpoint's path) without a look at its keys."""

    def save(batch: DataFrame, batch_id: int) -> None:
        if atomic:
            SnapshotTable(batch.sparkSession, output, keys).append(transform(batch), checkpoint, batch_id)
        else:
            upsert_append(batch.sparkSession, transform(batch), output, keys)

    query = (
        source.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_keyed(
    source: DataFrame,
    output: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = DETAIL_KEY,
    state_partitions: int = 200,
) -> int | None:
    """Drain a streaming file source into the Parquet table at ``output``, rows with unseen keys only, and stop.

    The keys seen so far are state of the query, kept in RocksDB and saved below ``checkpoint`` as changes: a batch is
    shuffled once by its keys and meets the state where that lies, so its cost does not depend on the size of the
    table, which is never read. The sink's log makes a batch visible whole and once; one that failed is repeated
    whole against the state of the batch before it. The first row of a key wins over later batches; of rows with one
    key in one batch any one stays. Null keys equal each other.

    The table belongs to this checkpoint: keys that others write to it are not known. ``state_partitions`` is fixed by the first
    run; each holds its share of all keys on an executor's disk. Returns the number of keys seen so far, None if
    nothing had arrived."""
    spark = source.sparkSession
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__compression__codec="zstd",
        spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
        spark__sql__shuffle__partitions=str(state_partitions),
    ):
        query = (
            transform(source)
            .dropDuplicates(list(keys))
            .writeStream.format("parquet")
            .option("path", output)
            .option("compression", "zstd")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    held = [step["stateOperators"][0]["numRowsTotal"] for step in query.recentProgress if step["stateOperators"]]
    return held[-1] if held else None


def payload_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 500) -> DataFrame:
    """Landed payload files as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
