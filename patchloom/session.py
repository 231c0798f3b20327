"""Session settings every job relies on, and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "patchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


# What one task takes must not grow with the tables: bytes read from files, bytes of joined shuffle partitions, and the
# number of partitions that a shuffle starts with before adaptive execution joins small ones.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
}
INITIAL_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
INITIAL_PARTITIONS = 400


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)(?:i?b)?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on, timestamps as UTC, and bound what one task takes; smaller settings stay."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, most in TASK_BYTES.items():
        if _bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    if int(spark.conf.get(INITIAL_KEY, None) or spark.conf.get("spark.sql.shuffle.partitions")) < INITIAL_PARTITIONS:
        spark.conf.set(INITIAL_KEY, str(INITIAL_PARTITIONS))
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's checkpoint folder.

    Only a session on one machine (master ``local``) may do without ``spark.checkpoint.dir``;
    it gets a temporary folder. On a cluster executors would not share one.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="patchloom-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/patchloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a block; a streaming query takes them over when it starts."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_freed(spark: SparkSession):
    """Writes within the block leave no shuffle files: what they wrote is read again, their shuffles are not."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared scratch folder and read them back: jobs that read them
    many times start from files, also after an executor is lost."""
    path = scratch_dir(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.parquet(path)
    table.scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete scratch tables of ``materialize`` whose last reader has been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
