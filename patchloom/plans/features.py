"""Feature table of pull requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import paths, text
from patchloom.operators.quality import assert_no_nulls, assert_unique
from patchloom.operators.reshape import one_hot, one_hot_vector

# Change status of a file.
STATUSES = ("added", "removed", "modified", "renamed", "copied", "changed", "unchanged")


def title_words(df: DataFrame, column: str = "pr_title") -> DataFrame:
    return df.withColumn("pr_title_length", text.word_count(F.col(column)))


def body_words(df: DataFrame, column: str = "pr_body") -> DataFrame:
    return df.withColumn("pr_body_length", text.word_count(F.col(column)))


def heading_score(df: DataFrame, column: str = "pr_body") -> DataFrame:
    """Distinct template headings over the largest number found in any row."""
    counted = df.withColumn("_headings", F.size(text.template_headings(F.col(column))))
    top = counted.agg(F.greatest(F.coalesce(F.max("_headings"), F.lit(0)), F.lit(1))).scalar()
    return counted.withColumn("common_template_heading_score", F.col("_headings") / top).drop("_headings")


def template_features(df: DataFrame, column: str = "pr_body", fixed: bool = False) -> DataFrame:
    """Issue link, heading score, checklist flag and their sum."""
    scored = heading_score(df, column).select(
        "*",
        text.has_issue_link(F.col(column)).alias("contains_issue_task_linking"),
        text.has_checklist(F.col(column), fixed).alias("contains_checklist_items"),
    )
    total = (
        F.col("contains_issue_task_linking").cast("double")
        + F.col("common_template_heading_score")
        + F.col("contains_checklist_items").cast("double")
    )
    return scored.withColumn("pr_template_total_score", total)


def code_flag(df: DataFrame, column: str = "pr_body") -> DataFrame:
    return df.withColumn("contains_code_snippets", text.has_code(F.col(column)))


def issue_counts(related: DataFrame) -> DataFrame:
    return related.where(F.col("pr_id").isNotNull()).groupBy("pr_id").agg(
        F.count("issue_id").alias("number_of_related_issues")
    )


def commit_counts(commits: DataFrame) -> DataFrame:
    """Commits per pull request and words per commit. Words of the joined messages are the sum
    of the words of each, so no text is put together; messages that are null count as commits."""
    words = F.sum(text.word_count(F.col("message")))
    grouped = commits.where(F.col("pr_id").isNotNull()).groupBy("pr_id").agg(
        F.count("sha").alias("number_of_commits"), words.alias("_words")
    )
    return grouped.select(
        "pr_id",
        "number_of_commits",
        F.try_divide(F.col("_words").cast("double"), "number_of_commits").alias("avg_commit_message_length"),
    )


def scope_counts(details: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """All file measures in one pass: first per (pull request, file), then per pull request.

    The first level makes the distinct counts plain counts and spreads a very large pull
    request over its files. A status a pull request lacks is null.
    """
    flags = [F.max((F.col("status") == s).cast("int")).alias(f"_{s}") for s in statuses]
    sums = ("additions", "deletions", "changes")
    files = (
        details.where(F.col("pr_id").isNotNull())
        .groupBy("pr_id", "filename")
        .agg(*[F.sum(c).alias(c) for c in sums], *flags)
    )
    by_status = [
        F.nullif(F.sum(F.when(F.col("filename").isNotNull(), F.col(f"_{s}"))), F.lit(0)).alias(s) for s in statuses
    ]
    return files.groupBy("pr_id").agg(
        F.count("filename").alias("number_of_files_changed"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("total_addition"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("total_deletion"),
        F.coalesce(F.sum("changes"), F.lit(0)).alias("total_changes"),
        *by_status,
        F.count_distinct(paths.module_l1(F.col("filename"))).alias("number_of_modules_l1_changed"),
        F.count_distinct(paths.module_l2(F.col("filename"))).alias("number_of_modules_l2_changed"),
    )


def files_by_status(details: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    return (
        details.where(F.col("pr_id").isNotNull())
        .groupBy("pr_id")
        .pivot("status", list(statuses))
        .agg(F.count_distinct("filename"))
    )


def build_features(
    base: DataFrame,
    types: DataFrame,
    related: DataFrame,
    commits: DataFrame,
    details: DataFrame,
    statuses: Sequence[str] = STATUSES,
) -> DataFrame:
    """``base``: pr_id, pr_title, pr_body. Adds every measure; rows of ``base`` are kept.

    Measures are dealt anew by pull request before they are joined. Rows that lie by pull request already would else be
    joined, sorted and counted in the tasks that join the measures, which take a page of memory for each of these steps.
    """
    own = code_flag(template_features(body_words(title_words(base))))
    scope = scope_counts(details, statuses).drop("number_of_modules_l2_changed")
    joined = own.join(types, on="pr_id", how="left")
    for part in (issue_counts(related), commit_counts(commits), scope):
        joined = joined.join(part.hint("rebalance", "pr_id"), on="pr_id", how="left")
    return joined


def fill_zero(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Null to 0 in every column; text columns get '0', flags become numbers."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if name in keep:
            out.append(col)
        elif kind == "string":
            out.append(F.coalesce(col, F.lit("0")).alias(name))
        elif kind == "boolean":
            out.append(F.coalesce(col.cast("int"), F.lit(0)).alias(name))
        else:
            out.append(F.coalesce(col, F.lit(0).cast(kind)).alias(name))
    return df.select(*out)


def labelled_matrix(
    features: DataFrame,
    similarity: DataFrame,
    threshold: float = 0.9,
    categories: Sequence[str] | None = None,
    check: bool = False,
) -> DataFrame:
    """Rows with a similarity, label 1 from the threshold on, zero-filled and one-hot encoded: columns for
    listed categories, else one sparse vector.

    Filling comes first: a missing task type becomes the category ``0``. With ``check`` the similarities must be
    one per pull request and not null.
    """
    if check:
        assert_unique(assert_no_nulls(similarity, ["pr_id", "similarity"]), ["pr_id"])
    labelled = features.join(similarity.select("pr_id", "similarity"), on="pr_id", how="inner")
    label = F.when(F.col("similarity") >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))
    kept = labelled.withColumn("label", label).drop("pr_title", "pr_body", "similarity", "total_changes")
    filled = fill_zero(kept, keep=["pr_id", "label"])
    wide = one_hot(filled, "task_type", categories) if categories is not None else one_hot_vector(filled, "task_type")
    return wide.drop("contains_issue_task_linking", "common_template_heading_score", "contains_checklist_items")


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("pr_id", "label", "is_test")]
