"""Landed API payloads as rows. Payload columns are JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.paths import repo_full_name

COMMIT_PAYLOAD = (
    "sha STRING, commit STRUCT<message: STRING, author: STRUCT<name: STRING, email: STRING, date: STRING>>, "
    "files ARRAY<STRUCT<filename: STRING, status: STRING, additions: BIGINT, deletions: BIGINT, "
    "changes: BIGINT, patch: STRING>>"
)
COMMIT_LIST = "ARRAY<STRUCT<sha: STRING>>"


def commit_files(df: DataFrame, payload: str = "payload", pr_id: str = "pr_id", sha: str | None = "sha") -> DataFrame:
    """One row per file of a commit payload; a commit without files gives no row.

    ``sha`` names the column of the requested commit; None takes it from the payload.
    """
    parsed = df.withColumn("_c", F.from_json(F.col(payload), COMMIT_PAYLOAD))
    key = F.col("_c.sha") if sha is None else F.col(sha)
    rows = parsed.select(key.alias("sha"), F.col(pr_id).alias("pr_id"), "_c.commit", F.explode("_c.files").alias("f"))
    return rows.select(
        "sha",
        "pr_id",
        F.col("f.filename").alias("file"),
        "f.status",
        "f.additions",
        "f.deletions",
        "f.changes",
        "f.patch",
        "commit.message",
        F.col("commit.author.name").alias("author"),
        F.col("commit.author.email").alias("author_email"),
        F.col("commit.author.date").alias("date"),
    )


def commit_shas(payload: Column) -> Column:
    """SHAs of a commit-list payload; entries without one are dropped."""
    listed = F.transform(F.from_json(payload, COMMIT_LIST), lambda c: c["sha"])
    return F.filter(listed, lambda s: F.coalesce(s != "", F.lit(False)))


def work_list(human_pr: DataFrame) -> DataFrame:
    """What is to be fetched: pr_id, pr_number, repo as ``owner/repo``."""
    return human_pr.select(
        F.col("id").alias("pr_id"), F.col("number").alias("pr_number"), repo_full_name(F.col("repo_url")).alias("repo")
    )
