"""Size and scope of changes, merge rates and task types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import paths, times
from patchloom.operators.cumulative import describe, percentiles, stack_metrics
from patchloom.operators.quality import assert_row_preserving

# Labels of the groups, and task types that are looked at together.
GROUP_NAMES = {1: "APR", 0: "HPR"}
MERGED_TASK_TYPES = {
    "build": "build & chore",
    "chore": "build & chore",
    "test": "test & docs",
    "docs": "test & docs",
}


def is_agent(agent: Column) -> Column:
    """0 for humans, 1 for everybody else, a missing author included."""
    return F.when(agent == "Human", F.lit(0)).otherwise(F.lit(1))


def closed_prs(pr: DataFrame) -> DataFrame:
    """Closed pull requests with the merged flag."""
    return pr.where(F.col("closed_at").isNotNull()).select(
        F.col("id").alias("pr_id"),
        "agent",
        "created_at",
        "closed_at",
        "merged_at",
        "state",
        F.when(F.col("merged_at").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("is_merged"),
    )


FILE_COLUMNS = ("pr_id", "sha", "filename", "status", "changes", "additions", "deletions")


def agent_files(details: DataFrame, columns: Sequence[str] = FILE_COLUMNS) -> DataFrame:
    return details.select(*columns)


def human_files(details: DataFrame, columns: Sequence[str] = FILE_COLUMNS) -> DataFrame:
    """Human rows name the file column differently."""
    return details.withColumnRenamed("file", "filename").select(*columns)


def change_table(pr: DataFrame, details: DataFrame, human_pr: DataFrame, human_details: DataFrame) -> DataFrame:
    """Closed pull requests with their file rows, group, month and folders."""
    agent = closed_prs(pr).join(agent_files(details), on="pr_id", how="inner")
    human = closed_prs(human_pr).join(human_files(human_details), on="pr_id", how="inner")
    return agent.unionByName(human).select(
        "*",
        is_agent(F.col("agent")).alias("is_agent"),
        times.year_month(times.parse_iso(F.col("created_at"))).alias("created_at_ym"),
        paths.module_l1(F.col("filename")).alias("module_l1"),
        paths.module_l2(F.col("filename")).alias("module_l2"),
    )


def task_types(agent_types: DataFrame, human_types: DataFrame) -> DataFrame:
    """pr_id and task type of both groups."""
    names = [F.col("id").alias("pr_id"), F.col("type").alias("task_type")]
    return human_types.select(*names).unionByName(agent_types.select(*names))


def add_task_type(df: DataFrame, types: DataFrame, check: bool = True) -> DataFrame:
    """Left join of the task type. A pull request with several types would multiply rows and is refused; without
    ``check`` nothing runs before the plan does."""
    if check:
        assert_row_preserving(types, ["pr_id"])
    return df.join(types, on="pr_id", how="left")


def unmatched_prs(closed: DataFrame, files: DataFrame) -> DataFrame:
    """Per group: closed pull requests and those of them without any file row."""
    known = files.select("pr_id").distinct().withColumn("_has", F.lit(1))
    return (
        closed.join(known, on="pr_id", how="left")
        .groupBy(is_agent(F.col("agent")).alias("is_agent"))
        .agg(F.count("*").alias("closed_prs"), F.count(F.when(F.col("_has").isNull(), 1)).alias("unmatched"))
    )


def merge_rates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct merged and unmerged pull requests per key; total and rate stay null for a
    key that lacks one of the two."""
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    wide = kept.groupBy(*keys).pivot("is_merged", [0, 1]).agg(F.count_distinct("pr_id"))
    total = F.col("0") + F.col("1")
    return wide.select(
        *keys,
        F.col("0").alias("unmerged"),
        F.col("1").alias("merged"),
        total.alias("total_prs"),
        F.try_divide(F.col("1"), total).alias("merge_rate"),
    )


def monthly_merge_rates(df: DataFrame, agent: bool = True) -> DataFrame:
    return merge_rates(df.where(F.col("is_agent") == int(agent)), ["created_at_ym"])


def per_pr(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and distinct counts of one pull request. Sums of nothing are 0.

    Two levels instead of four distinct counts over all rows: rows shrink to one per file and to
    one per commit first, and folders, which follow from the file name, are counted over files.
    """
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    sums = ("changes", "additions", "deletions")
    # A row for the file with its sums, and a row for the commit.
    part = F.explode(
        F.array(
            F.struct(F.lit(True).alias("of_file"), F.col("filename").alias("item"), *[F.col(c).cast("long").alias(c) for c in sums]),
            F.struct(
                F.lit(False).alias("of_file"), F.col("sha").alias("item"), *[F.lit(None).cast("long").alias(c) for c in sums]
            ),
        )
    )
    parts = kept.select(*keys, part.alias("p")).select(*keys, "p.*")
    items = parts.groupBy(*keys, "of_file", "item").agg(*[F.sum(c).alias(c) for c in sums])
    name = F.when(F.col("of_file"), F.col("item"))
    counted = items.select(*keys, *sums, "of_file", "item", paths.module_l1(name).alias("l1"), paths.module_l2(name).alias("l2"))
    return counted.groupBy(*keys).agg(
        F.coalesce(F.sum("changes"), F.lit(0)).alias("sum_changes"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
        F.count(F.when(F.col("of_file"), F.col("item"))).alias("num_file_changes"),
        F.count(F.when(~F.col("of_file"), F.col("item"))).alias("num_commits"),
        F.count_distinct("l1").alias("num_module_l1"),
        F.count_distinct("l2").alias("num_module_l2"),
    )


def monthly_change_stats(df: DataFrame, agent: bool | None = True) -> DataFrame:
    """Per month: lines summed, scope averaged over pull requests; of one group, or of both with ``is_agent`` as a key."""
    chosen = df if agent is None else df.where(F.col("is_agent") == int(agent))
    months = ["created_at_ym"] if agent is not None else ["is_agent", "created_at_ym"]
    prs = per_pr(chosen, ["pr_id", *months])
    return prs.groupBy(*months).agg(
        F.sum("sum_changes").alias("sum_changes"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.avg("num_file_changes").alias("num_file_changes"),
        F.avg("num_commits").alias("num_commits"),
        F.avg("num_module_l1").alias("num_module_l1"),
        F.avg("num_module_l2").alias("num_module_l2"),
    )


SCOPE_METRICS = ("num_commits", "sum_changes", "num_file_changes", "num_module_l1")


def group_medians(df: DataFrame) -> DataFrame:
    """Exact medians of the per-pull-request measures per group."""
    tall = stack_metrics(per_pr(df, ["pr_id", "is_agent"]), ["is_agent"], SCOPE_METRICS)
    medians = percentiles(tall, ["is_agent", "metric"], "value", {"median": 0.5})
    return medians.groupBy("is_agent").pivot("metric", list(SCOPE_METRICS)).agg(F.first("median"))


def pr_level(df: DataFrame) -> DataFrame:
    """Per pull request with the group label."""
    return per_pr(df, ["pr_id", "is_agent"]).withColumn("Group", paths.recode(F.col("is_agent"), GROUP_NAMES))


def nonzero_measures(df: DataFrame) -> DataFrame:
    """(pr_id, Group, metric, value) without the zero values: what a log-scale plot shows."""
    tall = stack_metrics(pr_level(df), ["pr_id", "Group"], ["num_file_changes", "additions", "deletions"])
    return tall.where(F.col("value") > 0)


def measure_summary(df: DataFrame, metrics: Sequence[str] = SCOPE_METRICS) -> DataFrame:
    return describe(stack_metrics(pr_level(df), ["Group"], metrics), ["Group", "metric"], "value")


def task_type_shares(df: DataFrame) -> DataFrame:
    """Pull requests per task type and their share within the group."""
    counts = (
        df.where(F.col("task_type").isNotNull())
        .groupBy("task_type", "is_agent")
        .agg(F.count_distinct("pr_id").alias("num_prs"))
    )
    total = F.sum("num_prs").over(Window.partitionBy("is_agent"))
    return counts.withColumn("total_prs", total).withColumn("pr_rate", F.col("num_prs") / F.col("total_prs"))


def task_type_table(df: DataFrame) -> DataFrame:
    """Mean share per task type with one column per group, agents first."""
    wide = task_type_shares(df).groupBy("task_type").pivot("is_agent", [0, 1]).agg(F.avg("pr_rate"))
    return wide.orderBy(F.col("1").desc_nulls_last())


def per_pr_merged_types(df: DataFrame) -> DataFrame:
    """Per pull request and merged task type; unmapped types fall out."""
    kind = paths.recode(F.col("task_type"), MERGED_TASK_TYPES)
    typed = df.withColumn("task_type", kind).where(F.col("task_type").isNotNull())
    return per_pr(typed, ["pr_id", "task_type"]).select(
        "pr_id", "task_type", "num_file_changes", "num_module_l1", "num_commits", F.col("sum_changes").alias("changes")
    )


def merge_rate_by_metric(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, value, merge_rate) over agent pull requests; values seen only merged or only
    unmerged are dropped."""
    prs = per_pr(df.where(F.col("is_agent") == 1), ["pr_id", "is_merged"])
    tall = stack_metrics(prs, ["is_merged"], metrics)
    wide = tall.groupBy("metric", "value").pivot("is_merged", [0, 1]).count()
    rate = F.try_divide(F.col("1"), F.col("0") + F.col("1"))
    return wide.select("metric", "value", rate.alias("merge_rate")).dropna()


def correlation_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns per key, as rows (x, y, r)."""
    pairs = [(x, y) for x in columns for y in columns]
    wide = df.groupBy(*keys).agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}|{y}").alias("r")) for x, y in pairs]
    return wide.select(*keys, F.inline(F.array(*cells)))
