"""Lifetime of added definitions, cohorts, and the next change of added files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import patches, paths, times
from patchloom.session import materialize


def patched_files(details: DataFrame, human_details: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """File rows of both groups that have a patch, tagged by group."""
    cols = ["pr_id", *extra, "filename", "patch", "status"]
    agent = details.where(F.col("patch").isNotNull()).select(*cols, F.lit(1).alias("is_agent"))
    human = (
        human_details.withColumnRenamed("file", "filename")
        .where(F.col("patch").isNotNull())
        .select(*cols, F.lit(0).alias("is_agent"))
    )
    return agent.unionByName(human)


def with_names(files: DataFrame) -> DataFrame:
    """Supported files with added and removed names; the patch text is dropped here, before any shuffle."""
    lang = files.withColumn("prog_lang", paths.language_of(F.col("filename"))).where(F.col("prog_lang").isNotNull())
    sets = lang.select("*", *patches.change_columns(F.col("patch"), F.col("prog_lang")))
    return sets.select(
        *[c for c in lang.columns if c != "patch"],
        patches.combined_names(F.col("added_functions"), F.col("added_classes")).alias("added_names"),
        patches.combined_names(F.col("removed_functions"), F.col("removed_classes")).alias("removed_names"),
    )


def name_events(named: DataFrame) -> DataFrame:
    """One row per (pr_id, is_agent, name) with the flags ``added`` and ``removed``.

    This is the long form of the per-pull-request lists: no list is ever built, so one pull
    request may hold any number of names.
    """

    def tagged(column: str, added: int) -> Column:
        return F.transform(
            F.col(column),
            lambda n: F.struct(n.alias("name"), F.lit(added).alias("added"), F.lit(1 - added).alias("removed")),
        )

    rows = named.select(
        "pr_id", "is_agent", F.inline(F.concat(tagged("added_names", 1), tagged("removed_names", 0)))
    )
    return rows.groupBy("pr_id", "is_agent", "name").agg(
        F.max("added").alias("added"), F.max("removed").alias("removed")
    )


def net_changes(events: DataFrame) -> DataFrame:
    """Per pull request and name: a name on both sides counts as removed, not as added."""
    return events.select(
        "pr_id",
        "is_agent",
        "name",
        ((F.col("added") == 1) & (F.col("removed") == 0)).alias("is_added"),
        (F.col("removed") == 1).alias("is_removed"),
    )


def repositories(pr: DataFrame, human_pr: DataFrame) -> DataFrame:
    """pr_id, repo_id as text, merge time: ids for agents, owner/repo for humans."""
    merged = times.parse_iso(F.col("merged_at")).alias("merged_at_dt")
    agent = pr.select(F.col("id").alias("pr_id"), F.col("repo_id").cast("string").alias("repo_id"), merged)
    human = human_pr.select(
        F.col("id").alias("pr_id"), paths.repo_full_name(F.col("repo_url")).alias("repo_id"), merged
    )
    return agent.unionByName(human)


def lifetimes(events: DataFrame, repos: DataFrame) -> DataFrame:
    """First addition of every name, with its first removal when that came later, from
    another pull request of the same repository.

    "First" is the smallest pull-request id over all repositories. Both firsts come out of
    one aggregation by name, combined before the shuffle, so a very common name is cheap and
    no join of additions with removals is needed.
    """
    merged = repos.where(F.col("merged_at_dt").isNotNull())
    rows = net_changes(events).join(merged, on="pr_id", how="inner")
    place = F.struct("pr_id", "merged_at_dt", "repo_id", "is_agent")
    first = rows.groupBy(F.col("name").alias("func_class")).agg(
        F.min(F.when(F.col("is_added"), place)).alias("a"), F.min(F.when(F.col("is_removed"), place)).alias("r")
    )
    matched = (
        F.col("a.repo_id").eqNullSafe(F.col("r.repo_id"))
        & (F.col("a.pr_id") != F.col("r.pr_id"))
        & (F.col("a.merged_at_dt") < F.col("r.merged_at_dt"))
    )
    return first.where(F.col("a").isNotNull()).select(
        F.col("a.repo_id").alias("repo_id"),
        F.col("a.pr_id").alias("added_pr_id"),
        F.col("a.merged_at_dt").alias("added_at_dt"),
        "func_class",
        F.when(matched, F.col("r.pr_id")).alias("removed_pr_id"),
        F.when(matched, F.col("r.merged_at_dt")).alias("removed_at_dt"),
        F.coalesce(matched, F.lit(False)).cast("int").alias("is_removed"),
        F.col("a.is_agent").alias("is_agent"),
    )


def with_task_types(life: DataFrame, types: DataFrame) -> DataFrame:
    """Task type of the adding and of the removing pull request, and the month of addition."""
    added = types.select(F.col("pr_id").alias("added_pr_id"), F.col("task_type").alias("added_task_type"))
    removed = types.select(F.col("pr_id").alias("removed_pr_id"), F.col("task_type").alias("removed_task_type"))
    joined = life.join(added, on="added_pr_id", how="left").join(removed, on="removed_pr_id", how="left")
    return joined.withColumn("added_batch", times.year_month(F.col("added_at_dt")))


def definition_lifetimes(
    pr: DataFrame, details: DataFrame, human_pr: DataFrame, human_details: DataFrame, types: DataFrame | None = None
) -> DataFrame:
    events = name_events(with_names(patched_files(details, human_details)))
    life = lifetimes(events, repositories(pr, human_pr))
    return life if types is None else with_task_types(life, types)


def between(ts: Column, start: str, end: str) -> Column:
    """Closed interval of UTC times."""
    return ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def churn_rates(life: DataFrame, keys: Sequence[str] = ("is_agent",)) -> DataFrame:
    """Distinct added and removed definitions and their ratio per key."""
    removed = F.count_distinct(F.when(F.col("is_removed") == 1, F.col("func_class")))
    counts = life.groupBy(*keys).agg(
        F.count_distinct("func_class").alias("definitions"), removed.alias("removed_definitions")
    )
    return counts.withColumn("churn_rate", F.try_divide("removed_definitions", "definitions"))


def with_gap(life: DataFrame) -> DataFrame:
    """Whole days from addition to removal."""
    return life.withColumn("gap", times.gap_days(F.col("added_at_dt"), F.col("removed_at_dt")))


# Months of a cohort and their offset in days.
COHORT_STEPS = {"M0": 0, "M1": 30, "M2": 60, "M3": 90}


def cohorts(life: DataFrame, start: str, end: str) -> DataFrame:
    """Each definition at 0, 30, 60 and 90 days. The removed flag compares calendar month
    numbers only, without the year, and is 0 without a removal."""
    chosen = life.where(between(F.col("added_at_dt"), start, end))
    ids = ["repo_id", "added_pr_id", "func_class", "added_at_dt", "removed_at_dt", "is_agent"]
    steps = [times.plus_days(F.col("added_at_dt"), d).alias(m) for m, d in COHORT_STEPS.items()]
    tall = chosen.select(*ids, *steps).unpivot(ids, list(COHORT_STEPS), "month_order", "month_order_dt")
    gone = F.coalesce(F.month("month_order_dt") >= F.month("removed_at_dt"), F.lit(False))
    return tall.select(
        "*", gone.cast("int").alias("is_removed"), times.year_month(F.col("added_at_dt")).alias("added_batch")
    )


def survival(cohort: DataFrame) -> DataFrame:
    """Distinct surviving definitions per cohort month, group and step."""
    return (
        cohort.where(F.col("is_removed") == 0)
        .groupBy("added_batch", "is_agent", "month_order")
        .agg(F.count_distinct("func_class").alias("alive"))
    )


FILE_KEY = ("is_agent", "repo_id", "filename")


def _merged_touches(
    pr: DataFrame, details: DataFrame, human_pr: DataFrame, human_details: DataFrame, statuses: Sequence[str]
) -> DataFrame:
    """Distinct (pr_id, file) rows with one of the statuses that belong to merged pull requests."""

    def side(files: DataFrame, prs: DataFrame, repo: Column, tag: int) -> DataFrame:
        merged = prs.where(F.col("merged_at").isNotNull()).select(
            F.col("id").alias("pr_id"), repo.alias("repo_id"), times.parse_iso(F.col("merged_at")).alias("at")
        )
        rows = files.where(F.col("status").isin(*statuses)).select("pr_id", "filename")
        return rows.join(merged, on="pr_id", how="inner").withColumn("is_agent", F.lit(tag))

    agent = side(details, pr, F.col("repo_id").cast("string"), 1)
    renamed = human_details.withColumnRenamed("file", "filename")
    human = side(renamed, human_pr, paths.repo_short_name(F.col("repo_url")), 0)
    return agent.unionByName(human)


def _latest(touches: DataFrame, pr_name: str, at_name: str) -> DataFrame:
    """The touch with the largest pull-request id per file; ids and times are combined by hash, without a sort."""
    return touches.groupBy(*FILE_KEY).agg(
        F.max("pr_id").alias(pr_name), F.max_by("at", "pr_id").alias(at_name)
    )


def latest_additions(
    pr: DataFrame, details: DataFrame, human_pr: DataFrame, human_details: DataFrame
) -> DataFrame:
    """Per file of a repository the latest pull request that added it."""
    return _latest(_merged_touches(pr, details, human_pr, human_details, ["added"]), "pr_id", "added_at")


def latest_modifications(
    pr: DataFrame,
    details: DataFrame,
    human_pr: DataFrame,
    human_details: DataFrame,
    additions: DataFrame,
    statuses: Sequence[str] = ("modified", "removed"),
) -> DataFrame:
    """Per file the latest change by a pull request that is not the kept adder of any file."""
    touches = _merged_touches(pr, details, human_pr, human_details, statuses)
    others = touches.join(additions.select("pr_id"), on="pr_id", how="left_anti")
    return _latest(others, "next_modified_pr_id", "next_modified_at")


def next_modification(
    pr: DataFrame, details: DataFrame, human_pr: DataFrame, human_details: DataFrame
) -> DataFrame:
    """Added files with a later change and the hours in between."""
    # Read twice, as left side and for the pull requests to leave out.
    added = materialize(latest_additions(pr, details, human_pr, human_details), "additions")
    changed = latest_modifications(pr, details, human_pr, human_details, added)
    right = changed.select(
        *[F.col(k).alias(f"_{k}") for k in FILE_KEY], "next_modified_pr_id", "next_modified_at"
    )
    same_file = (
        (F.col("is_agent") == F.col("_is_agent"))
        & (F.col("filename") == F.col("_filename"))
        & F.col("repo_id").eqNullSafe(F.col("_repo_id"))
        & (F.col("next_modified_at") > F.col("added_at"))
    )
    joined = added.join(right, on=same_file, how="inner").drop(*[f"_{k}" for k in FILE_KEY])
    return joined.withColumn("gap_in_hours", times.gap_hours(F.col("added_at"), F.col("next_modified_at")))
