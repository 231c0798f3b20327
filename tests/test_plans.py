"""Whole analyses on hand-made tables: the semantics that are easy to get wrong."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from patchloom.plans import change_size, churn, features, textpairs
from patchloom.sources.catalog import SCHEMAS


def prs(spark, rows, human=False):
    """rows: (id, repo, merged_at or None)."""
    if human:
        data = [(i, i, "Human", "t", "b", f"https://x/{r}", "u", "s", "2025-01-01T00:00:00Z", m, m) for i, r, m in rows]
        return spark.createDataFrame(data, SCHEMAS["human_pull_request"])
    data = [(i, "bot", "t", "b", r, "u", "s", "2025-01-01T00:00:00Z", m, m) for i, r, m in rows]
    return spark.createDataFrame(data, SCHEMAS["pull_request"])


def details(spark, rows, human=False):
    """rows: (pr, file, status, patch)."""
    if human:
        data = [(f"s{p}", p, f, st, 1, 1, 2, x, "m", "a", "e", "d") for p, f, st, x in rows]
        return spark.createDataFrame(data, SCHEMAS["human_pr_commit_details"])
    data = [(p, f"s{p}", f, st, 1, 1, 2, x, "m") for p, f, st, x in rows]
    return spark.createDataFrame(data, SCHEMAS["pr_commit_details"])


def lifetimes(spark, agent_prs, agent_rows, human_prs=(), human_rows=()):
    life = churn.definition_lifetimes(
        prs(spark, list(agent_prs)), details(spark, list(agent_rows)),
        prs(spark, list(human_prs), True), details(spark, list(human_rows), True),
    )
    return {r.func_class: r for r in life.collect()}


DAY = "2025-01-{:02d}T00:00:00Z".format


def test_lifetime_rules(spark):
    life = lifetimes(
        spark,
        [(1, 10, DAY(1)), (2, 10, DAY(5)), (3, 20, DAY(9)), (4, 10, None), (5, 10, DAY(2))],
        [
            (1, "a.py", "added", "+def kept():\n+def gone():\n+def moved():\n+def both():\n+def early():\n-def both():"),
            (2, "a.py", "modified", "-def gone():\n+def late():"),
            (3, "a.py", "modified", "-def moved():"),  # another repository: no match
            (4, "a.py", "added", "+def unmerged():"),
            (5, "a.py", "modified", "-def early():\n-def late():"),  # removed before 'late' was added
            (1, "b.md", "added", "+def text():"),
            (1, "c.py", "added", None),
        ],
        [(6, "own/rep", DAY(3))],
        [(6, "z.go", "added", "+func Run() {")],
    )
    assert set(life) == {"kept", "gone", "moved", "early", "late", "Run"}
    assert {n for n, r in life.items() if r.is_removed} == {"gone", "early"}
    assert life["gone"].removed_pr_id == 2
    assert life["Run"].is_agent == 0 and life["Run"].repo_id == "own/rep"
    # 'both' is on both sides of one pull request: it is removed, not added
    assert "both" not in life


def test_first_removal_in_another_repository_hides_a_later_match(spark):
    life = lifetimes(
        spark,
        [(1, 10, DAY(1)), (2, 20, DAY(2)), (3, 10, DAY(3))],
        [(1, "a.py", "added", "+def f():"), (2, "a.py", "removed", "-def f():"), (3, "a.py", "removed", "-def f():")],
    )
    assert life["f"].is_removed == 0


def test_missing_repository_matches_itself(spark):
    life = lifetimes(
        spark,
        [(1, None, DAY(1)), (2, None, DAY(2))],
        [(1, "a.py", "added", "+def f():"), (2, "a.py", "removed", "-def f():")],
    )
    assert life["f"].is_removed == 1


def test_cohort_flag_compares_month_numbers(spark):
    rows = [("r", 1, "same_year", "2025-01-20", "2025-03-01"), ("r", 1, "next_year", "2025-01-20", "2026-01-05"), ("r", 1, "never", "2025-01-20", None)]
    life = spark.createDataFrame(rows, "repo_id STRING, added_pr_id LONG, func_class STRING, a STRING, r STRING").select(
        "repo_id", "added_pr_id", "func_class", F.to_timestamp("a").alias("added_at_dt"), F.to_timestamp("r").alias("removed_at_dt"), F.lit(1).alias("is_agent")
    )
    got = {(r.func_class, r.month_order): r.is_removed for r in churn.cohorts(life, "2025-01-01", "2025-04-01").collect()}
    assert [got[("same_year", m)] for m in ("M0", "M1", "M2", "M3")] == [0, 0, 1, 1]
    assert [got[("next_year", m)] for m in ("M0", "M3")] == [1, 1]  # the year is not looked at
    assert [got[("never", m)] for m in ("M0", "M3")] == [0, 0]
    assert churn.cohorts(life, "2025-01-20", "2025-01-20").count() == 12  # both ends count


def test_next_modification_uses_latest_adder_and_excludes_it(spark):
    rows = [
        (1, "f", "added", None), (2, "f", "added", None), (2, "g", "modified", None), (3, "f", "modified", None),
        (4, "f", "removed", None), (5, "g", "added", None), (6, "g", "renamed", None),
    ]
    agent = prs(spark, [(i, 10, DAY(i)) for i in range(1, 7)])
    got = churn.next_modification(agent, details(spark, rows), prs(spark, [], True), details(spark, [], True)).collect()
    assert [(r.filename, r.pr_id, r.next_modified_pr_id, r.gap_in_hours) for r in got] == [("f", 2, 4, 48.0)]


def test_merge_rate_is_null_when_a_side_is_missing(spark):
    df = spark.createDataFrame([(1, "2025-01", 1, 1), (2, "2025-01", 0, 1), (3, "2025-02", 1, 1), (4, None, 1, 1)], "pr_id LONG, created_at_ym STRING, is_merged INT, is_agent INT")
    got = {r.created_at_ym: r for r in change_size.monthly_merge_rates(df).collect()}
    assert set(got) == {"2025-01", "2025-02"}
    assert got["2025-01"].merge_rate == 0.5
    assert got["2025-02"].total_prs is None and got["2025-02"].merge_rate is None


def test_null_author_counts_as_agent(spark):
    df = spark.createDataFrame([("Human",), (None,), ("x",)], "agent STRING")
    assert [r.a for r in df.select(change_size.is_agent(F.col("agent")).alias("a")).collect()] == [0, 1, 1]


def test_description_repeats_per_commit(spark):
    agent = prs(spark, [(1, 10, DAY(1))])
    rows = spark.createDataFrame([(1, s, f, "added", 1, 1, 2, "+x", m) for s, f, m in (("b", "f", "two"), ("a", "f", "one"), ("a", "g", "one"), ("c", "f", None))], SCHEMAS["pr_commit_details"])
    got = textpairs.pr_text_pairs(rows, details(spark, [], True), agent, prs(spark, [], True)).collect()
    assert [(r.pr_id, r.message, r.pr_description) for r in got] == [(1, "one two", "t b t b")]


def test_feature_rules(spark):
    commits = spark.createDataFrame([(1, "a", "x y"), (1, "b", None), (2, "c", None)], "pr_id LONG, sha STRING, message STRING")
    got = {r.pr_id: r for r in features.commit_counts(commits).collect()}
    assert got[1].number_of_commits == 2 and got[1].avg_commit_message_length == 1.0
    assert got[2].avg_commit_message_length is None
    rows = spark.createDataFrame([(1, "d/a", "added", 3, None, 3), (1, "d/a", "modified", None, None, None), (1, "e/b", "added", 1, None, 1)], "pr_id LONG, filename STRING, status STRING, additions LONG, deletions LONG, changes LONG")
    scope = features.scope_counts(rows).first()
    assert (scope.number_of_files_changed, scope.added, scope.modified, scope.removed) == (2, 2, 1, None)
    assert (scope.total_addition, scope.total_deletion, scope.number_of_modules_l1_changed) == (4, 0, 2)


def test_missing_task_type_becomes_a_category(spark):
    df = spark.createDataFrame([(1, "fix", 1, True), (2, None, None, None)], "pr_id LONG, task_type STRING, n LONG, b BOOLEAN")
    rows = features.fill_zero(df).orderBy("pr_id").collect()
    assert rows[1].asDict() == {"pr_id": 2, "task_type": "0", "n": 0, "b": 0}


def test_checks_in_the_plans(spark):
    from patchloom.operators.quality import DataCheckError
    from patchloom.plans.change_size import add_task_type, unmatched_prs
    from patchloom.plans.features import labelled_matrix

    prs = spark.createDataFrame([(1, "Human"), (2, None)], "pr_id LONG, agent STRING")
    twice = spark.createDataFrame([(1, "fix"), (1, "feat")], "pr_id LONG, task_type STRING")
    with pytest.raises(DataCheckError):
        add_task_type(prs, twice)
    assert add_task_type(prs, twice, check=False).count() == 3
    got = {tuple(r) for r in unmatched_prs(prs, twice).collect()}
    assert got == {(0, 1, 0), (1, 1, 1)}
    holes = spark.createDataFrame([(1, None)], "pr_id LONG, similarity DOUBLE")
    with pytest.raises(DataCheckError):
        labelled_matrix(add_task_type(prs, twice, check=False), holes, check=True)
