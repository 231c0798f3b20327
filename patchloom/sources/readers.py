"""Table scans by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json")


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def format_of(path: str, allowed: tuple[str, ...] = FORMATS) -> str:
    kind = suffix_of(path)
    if kind not in allowed:
        raise ValueError(f"unsupported file format '.{kind}' of {path}; use one of {allowed}")
    return kind


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header; quoted texts may hold line breaks and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """JSON Lines, or with ``lines=False`` one array or object per file; a malformed record fails the read."""
    return spark.read.json(path, schema=schema, multiLine=not lines, mode="FAILFAST")


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    allowed: tuple[str, ...] = FORMATS,
    lines: bool = True,
) -> DataFrame:
    """Scan by file suffix. CSV needs a schema so that the file is read once; ``lines`` holds for JSON."""
    kind = format_of(path, allowed)
    if kind == "parquet":
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if kind == "json":
        return read_json(spark, path, schema, lines)
    if schema is None:
        raise ValueError("a CSV scan needs a schema")
    return read_csv(spark, path, schema)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its full text in ``value``."""
    return spark.read.text(path, wholetext=True)


def text_literal(spark: SparkSession, path: str) -> Column:
    """The text of one small file, such as a prompt template, as a literal."""
    rows = read_whole_text(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one file at {path}")
    return F.lit(rows[0].value)
