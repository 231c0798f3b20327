"""Declared tables: schema by name, location by configuration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Schemas as DDL text, so that they need no running session.
SCHEMAS: dict[str, str] = {
    "pull_request": (
        "id LONG, agent STRING, title STRING, body STRING, repo_id LONG, html_url STRING, state STRING, "
        "created_at STRING, closed_at STRING, merged_at STRING"
    ),
    "human_pull_request": (
        "id LONG, number LONG, agent STRING, title STRING, body STRING, repo_url STRING, html_url STRING, "
        "state STRING, created_at STRING, closed_at STRING, merged_at STRING"
    ),
    "pr_commits": ("pr_id LONG, sha STRING, message STRING"),
    "pr_commit_details": (
        "pr_id LONG, sha STRING, filename STRING, status STRING, additions LONG, deletions LONG, changes LONG, "
        "patch STRING, message STRING"
    ),
    "human_pr_commit_details": (
        "sha STRING, pr_id LONG, file STRING, status STRING, additions LONG, deletions LONG, changes LONG, "
        "patch STRING, message STRING, author STRING, author_email STRING, date STRING"
    ),
    "pr_task_type": ("agent STRING, id LONG, title STRING, reason STRING, type STRING, confidence LONG"),
    "human_pr_task_type": ("id LONG, type STRING"),
    "related_issue": ("pr_id LONG, issue_id LONG"),
    "commit_corpus": ("hash STRING, diff STRING, message STRING, diff_languages STRING"),
    "description_corpus": ("text STRING, description STRING"),
    "text_pair": (
        "pr_id LONG, is_agent INT, message STRING, pr_description STRING, language STRING, confidence DOUBLE, "
        "similarity DOUBLE"
    ),
    "judge_score": (
        "sha STRING, is_agent INT, message STRING, patch STRING, what_score INT, why_score INT"
    ),
}


@dataclass
class Catalog:
    """Table name to path; a scan declares its schema and reads only the named columns."""

    paths: dict[str, str] = field(default_factory=dict)

    def scan(self, spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
        df = reader.parquet(self.paths[name])
        return df.select(*columns) if columns else df
