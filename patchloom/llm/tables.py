"""Shared plumbing of the operators: Arrow passes over a table, scratch tables, column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.session import materialize, release, scratch_dir

__all__ = ["arrow_pass", "materialize", "partitions", "read", "release", "scratch_dir"]


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark) -> int:
    """How many partitions the session asks a shuffle to have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_pass(df: DataFrame, schema: str | T.StructType, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` for work that yields dicts of columns."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        for out in work(batches):
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in target)], schema=target)
            yield out

    return df.mapInArrow(run, schema)
