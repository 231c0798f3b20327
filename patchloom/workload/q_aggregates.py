"""Aggregations (A), windows (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text
from patchloom.operators import cumulative, predictors, quality
from patchloom.operators.textjoin import join_lists, join_texts
from patchloom.plans import change_size, features, textpairs
from patchloom.workload.common import describe_sql, tidy
from patchloom.workload.registry import query
from patchloom.workload.views import Views

ROWS = ("change_rows",)

PER_PR = """per_pr AS (SELECT pr_id, is_agent, sum(changes)::BIGINT AS sum_changes, sum(additions)::BIGINT AS additions,
    sum(deletions)::BIGINT AS deletions, count(DISTINCT filename) AS num_file_changes, count(DISTINCT sha) AS num_commits,
    count(DISTINCT module_l1) AS num_module_l1, count(DISTINCT module_l2) AS num_module_l2
  FROM change_rows GROUP BY pr_id, is_agent)"""


@query(
    "a01_distinct_prs",
    "SELECT count(DISTINCT pr_id) AS prs, count(DISTINCT filename) AS files FROM change_rows",
    ROWS,
)
def a01(v: Views) -> DataFrame:
    return v.change_table().agg(
        F.count_distinct("pr_id").alias("prs"), F.count_distinct("filename").alias("files")
    )


@query(
    "a02_prs_per_group",
    "SELECT is_agent, count(DISTINCT pr_id) AS prs FROM change_rows GROUP BY is_agent",
    ROWS,
)
def a02(v: Views) -> DataFrame:
    return v.change_table().groupBy("is_agent").agg(F.count_distinct("pr_id").alias("prs"))


@query("a03_measures_per_pr", f"WITH {PER_PR} SELECT * FROM per_pr", ROWS)
def a03(v: Views) -> DataFrame:
    return change_size.per_pr(v.change_table(), ["pr_id", "is_agent"])


@query(
    "a04_monthly_change_stats",
    f"""WITH {PER_PR}, months AS (SELECT DISTINCT pr_id, created_at_ym FROM change_rows)
    SELECT is_agent, created_at_ym, sum(sum_changes)::BIGINT AS sum_changes, sum(additions)::BIGINT AS additions,
      sum(deletions)::BIGINT AS deletions, round(avg(num_file_changes), 6) AS num_file_changes,
      round(avg(num_commits), 6) AS num_commits, round(avg(num_module_l1), 6) AS num_module_l1,
      round(avg(num_module_l2), 6) AS num_module_l2
    FROM per_pr JOIN months USING (pr_id) GROUP BY is_agent, created_at_ym""",
    ROWS,
)
def a04(v: Views) -> DataFrame:
    return tidy(change_size.monthly_change_stats(v.change_table(), None))


@query(
    "a05_group_medians",
    f"""WITH {PER_PR} SELECT is_agent, median(num_commits) AS num_commits, median(sum_changes) AS sum_changes,
      median(num_file_changes) AS num_file_changes, median(num_module_l1) AS num_module_l1
    FROM per_pr GROUP BY is_agent""",
    ROWS,
)
def a05(v: Views) -> DataFrame:
    return change_size.group_medians(v.change_table())


@query(
    "a06_line_sums_per_pr",
    """SELECT pr_id, coalesce(sum(additions), 0)::BIGINT AS total_addition, coalesce(sum(deletions), 0)::BIGINT AS total_deletion,
      coalesce(sum(changes), 0)::BIGINT AS total_changes FROM details_all GROUP BY pr_id""",
    ("details_all",),
)
def a06(v: Views) -> DataFrame:
    sums = [("additions", "total_addition"), ("deletions", "total_deletion"), ("changes", "total_changes")]
    return (
        v.all_details()
        .groupBy("pr_id")
        .agg(*[F.coalesce(F.sum(src), F.lit(0)).alias(out) for src, out in sums])
    )


@query(
    "a07_related_issue_counts",
    "SELECT pr_id, count(issue_id) AS number_of_related_issues FROM related WHERE pr_id IS NOT NULL GROUP BY pr_id",
    ("related",),
)
def a07(v: Views) -> DataFrame:
    return features.issue_counts(v.related_issues())


@query(
    "a08_removed_task_type_counts",
    """SELECT t.is_agent, task_type, count(*) AS n FROM change_rows c JOIN types_all t USING (pr_id)
    WHERE task_type IS NOT NULL GROUP BY t.is_agent, task_type""",
    ("change_rows", "types_all"),
)
def a08(v: Views) -> DataFrame:
    types = change_size.task_types(v.agent_types(), v.human_types())
    typed = change_size.add_task_type(v.change_table(), types).where(F.col("task_type").isNotNull())
    return typed.groupBy("is_agent", "task_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(
    "a09_merged_counts_unstacked",
    f"""WITH {PER_PR}, m AS (SELECT DISTINCT pr_id, is_merged FROM change_rows)
    SELECT num_file_changes, nullif(count(*) FILTER (is_merged = 0), 0) AS not_merged,
      nullif(count(*) FILTER (is_merged = 1), 0) AS merged
    FROM per_pr JOIN m USING (pr_id) WHERE is_agent = 1 GROUP BY num_file_changes""",
    ROWS,
)
def a09(v: Views) -> DataFrame:
    agent = v.change_table().where(F.col("is_agent") == 1)
    prs = agent.groupBy("pr_id", "is_merged").agg(F.count_distinct("filename").alias("num_file_changes"))
    wide = prs.groupBy("num_file_changes").pivot("is_merged", [0, 1]).count()
    return wide.toDF("num_file_changes", "not_merged", "merged")


@query(
    "a10_merge_rate_by_month",
    """WITH c AS (SELECT is_agent, created_at_ym, nullif(count(DISTINCT CASE WHEN is_merged = 0 THEN pr_id END), 0) AS unmerged,
      nullif(count(DISTINCT CASE WHEN is_merged = 1 THEN pr_id END), 0) AS merged FROM change_rows GROUP BY ALL)
    SELECT *, unmerged + merged AS total_prs, round(merged / (unmerged + merged), 6) AS merge_rate FROM c""",
    ROWS,
)
def a10(v: Views) -> DataFrame:
    return tidy(change_size.merge_rates(v.change_table(), ["is_agent", "created_at_ym"]))


@query(
    "a11_merge_rate_by_group",
    """WITH c AS (SELECT is_agent, nullif(count(DISTINCT CASE WHEN is_merged = 0 THEN pr_id END), 0) AS unmerged,
      nullif(count(DISTINCT CASE WHEN is_merged = 1 THEN pr_id END), 0) AS merged FROM change_rows GROUP BY ALL)
    SELECT *, unmerged + merged AS total_prs, round(merged / (unmerged + merged), 6) AS merge_rate FROM c""",
    ROWS,
)
def a11(v: Views) -> DataFrame:
    return tidy(change_size.merge_rates(v.change_table(), ["is_agent"]))


RATE_BY_METRIC = f"""WITH {PER_PR}, m AS (SELECT DISTINCT pr_id, is_merged FROM change_rows),
  tall AS (SELECT is_merged, unnest(['num_file_changes', 'num_module_l1', 'num_commits']) AS metric,
      CAST(unnest([num_file_changes, num_module_l1, num_commits]) AS DOUBLE) AS value
    FROM per_pr JOIN m USING (pr_id) WHERE is_agent = 1),
  rates AS (SELECT metric, value, count(*) FILTER (is_merged = 1) / count(*) AS merge_rate FROM tall
    GROUP BY metric, value HAVING count(*) FILTER (is_merged = 1) > 0 AND count(*) FILTER (is_merged = 0) > 0)"""
CORRELATED = ("num_file_changes", "num_module_l1", "num_commits")


@query(
    "a12_merge_rate_by_metric",
    RATE_BY_METRIC + " SELECT metric, value, round(merge_rate, 6) AS merge_rate FROM rates",
    ROWS,
)
def a12(v: Views) -> DataFrame:
    return tidy(change_size.merge_rate_by_metric(v.change_table(), CORRELATED))


@query(
    "a13_correlation_matrix",
    RATE_BY_METRIC
    + """ SELECT metric, x, y, round(r, 6) AS r FROM (SELECT metric, unnest(['value', 'value', 'merge_rate', 'merge_rate']) AS x,
      unnest(['value', 'merge_rate', 'value', 'merge_rate']) AS y,
      unnest([corr(value, value), corr(value, merge_rate), corr(merge_rate, value), corr(merge_rate, merge_rate)]) AS r
      FROM rates GROUP BY metric)""",
    ROWS,
)
def a13(v: Views) -> DataFrame:
    rates = change_size.merge_rate_by_metric(v.change_table(), CORRELATED)
    return tidy(change_size.correlation_matrix(rates, ["metric"], ["value", "merge_rate"]))


@query(
    "a14_describe_global",
    "WITH m AS (SELECT length(message) AS len FROM (SELECT DISTINCT pr_id, sha, message FROM details_all)) "
    + describe_sql("", "len", "m"),
    ("details_all",),
)
def a14(v: Views) -> DataFrame:
    lengths = textpairs.message_lengths(v.all_details())
    return tidy(cumulative.describe(lengths, [], "commit_message_len"))


@query(
    "a15_describe_per_group",
    f"""WITH {PER_PR}, tall AS (SELECT CASE is_agent WHEN 1 THEN 'APR' ELSE 'HPR' END AS "Group",
      unnest(['num_commits', 'sum_changes', 'num_file_changes', 'num_module_l1']) AS metric,
      unnest([num_commits, sum_changes, num_file_changes, num_module_l1]) AS value FROM per_pr) """
    + describe_sql('"Group", metric', "value", "tall"),
    ROWS,
)
def a15(v: Views) -> DataFrame:
    return tidy(change_size.measure_summary(v.change_table()))


SHARES = """s AS (SELECT task_type, is_agent, num_prs, (sum(num_prs) OVER (PARTITION BY is_agent))::BIGINT AS total_prs FROM
    (SELECT task_type, c.is_agent, count(DISTINCT pr_id) AS num_prs FROM change_rows c JOIN types_all t USING (pr_id)
     WHERE task_type IS NOT NULL GROUP BY ALL))"""


@query(
    "a16_task_type_table",
    f"""WITH {SHARES} SELECT task_type, round(max(CASE WHEN is_agent = 0 THEN num_prs / total_prs END), 6) AS "0",
      round(max(CASE WHEN is_agent = 1 THEN num_prs / total_prs END), 6) AS "1" FROM s GROUP BY task_type""",
    ("change_rows", "types_all"),
)
def a16(v: Views) -> DataFrame:
    return tidy(change_size.task_type_table(_typed(v)))


def _typed(v: Views) -> DataFrame:
    return change_size.add_task_type(
        v.change_table(), change_size.task_types(v.agent_types(), v.human_types())
    )


@query(
    "a17_files_by_status",
    """SELECT pr_id, nullif(count(DISTINCT CASE WHEN status = 'added' THEN filename END), 0) AS added,
      nullif(count(DISTINCT CASE WHEN status = 'removed' THEN filename END), 0) AS removed,
      nullif(count(DISTINCT CASE WHEN status = 'modified' THEN filename END), 0) AS modified
    FROM details_all GROUP BY pr_id""",
    ("details_all",),
)
def a17(v: Views) -> DataFrame:
    return features.files_by_status(v.all_details(), ("added", "removed", "modified"))


@query(
    "a18_messages_per_pr",
    """SELECT pr_id, 0 AS part, string_agg(message, ' ' ORDER BY sha) AS message, count(*) AS rows
    FROM (SELECT DISTINCT pr_id, sha, message FROM commits) WHERE message IS NOT NULL GROUP BY pr_id""",
    ("commits",),
)
def a18(v: Views) -> DataFrame:
    commits = v.commits().where(F.col("message").isNotNull())
    return join_texts(commits, ["pr_id"], {"message": "message"}, ["sha"], " ")


@query(
    "a19_patches_per_commit",
    """SELECT sha, is_agent, 0 AS part, string_agg(patch, chr(10) ORDER BY patch) AS patch, count(*) AS rows FROM
      (SELECT DISTINCT sha, is_agent, patch FROM details_all WHERE patch IS NOT NULL) GROUP BY sha, is_agent""",
    ("details_all",),
)
def a19(v: Views) -> DataFrame:
    rows = (
        v.all_details(narrow=True)
        .where(F.col("patch").isNotNull())
        .select("sha", change_size.is_agent(F.col("agent")).alias("is_agent"), "patch")
    )
    return join_texts(rows, ["sha", "is_agent"], {"patch": "patch"}, ["patch"], "\n", distinct=True)


@query(
    "a20_file_lists_per_pr",
    """SELECT pr_id, 0 AS part, string_agg(filename || ',' || status, ';' ORDER BY sha, filename, status) AS items
    FROM details_all GROUP BY pr_id""",
    ("details_all",),
)
def a20(v: Views) -> DataFrame:
    # An item orders as its file name and status do; as a text beside them it would be shuffled a second time.
    rows = v.all_details(narrow=True).select("pr_id", "sha", F.array(F.struct("filename", "status")).alias("items"))
    lists = join_lists(rows, ["pr_id"], ["items"], ["sha"])
    texts = F.transform("items", lambda i: F.concat_ws(",", i["filename"], i["status"]))
    return lists.select("pr_id", "part", F.array_join(texts, ";").alias("items"))


@query(
    "a21_distinct_rows",
    "SELECT DISTINCT sha, pr_id, message, is_agent FROM details_all WHERE patch IS NOT NULL",
    ("details_all",),
)
def a21(v: Views) -> DataFrame:
    agent = textpairs.commit_messages(v.details(), 1)
    return agent.unionByName(textpairs.commit_messages(v.human_details(), 0))


@query(
    "a22_first_row_per_key",
    """SELECT filename, pr_id, merged_at FROM (SELECT d.filename, d.pr_id, p.merged_at,
      row_number() OVER (PARTITION BY d.filename ORDER BY d.pr_id, p.merged_at) AS rn
      FROM details_all d JOIN pr_all p ON p.id = d.pr_id WHERE p.merged_at IS NOT NULL) WHERE rn = 1""",
    ("details_all", "pr_all"),
)
def a22(v: Views) -> DataFrame:
    from patchloom.sources.sinks import first_per_key

    merged = v.all_prs().where(F.col("merged_at").isNotNull()).select(F.col("id").alias("pr_id"), "merged_at")
    rows = v.all_details().select("pr_id", "filename").join(merged, "pr_id")
    return first_per_key(rows.select("filename", "pr_id", "merged_at"), ["filename"], ["pr_id", "merged_at"])


@query(
    "a23_null_ratios",
    """SELECT round(avg(CAST(patch IS NULL AS INT)), 6) AS patch, round(avg(CAST(message IS NULL AS INT)), 6) AS message,
      round(avg(CAST(filename IS NULL AS INT)), 6) AS filename FROM details_all""",
    ("details_all",),
)
def a23(v: Views) -> DataFrame:
    return tidy(quality.null_ratios(v.all_details(), ["patch", "message", "filename"]))


@query(
    "a24_global_max_share",
    """SELECT pr_id, round(n / (SELECT max(n) FROM (SELECT pr_id, count(*) AS n FROM details_all GROUP BY pr_id)), 6) AS share
    FROM (SELECT pr_id, count(*) AS n FROM details_all GROUP BY pr_id)""",
    ("details_all",),
)
def a24(v: Views) -> DataFrame:
    counts = v.all_details().groupBy("pr_id").agg(F.count("*").alias("n"))
    return tidy(counts.select("pr_id", (F.col("n") / counts.agg(F.max("n")).scalar()).alias("share")))


@query(
    "a26_large_groups",
    """SELECT diff_languages, count(DISTINCT hash) AS commits FROM corpus GROUP BY diff_languages
    HAVING count(DISTINCT hash) > 100""",
    ("corpus",),
)
def a26(v: Views) -> DataFrame:
    counts = v.corpus().groupBy("diff_languages").agg(F.count_distinct("hash").alias("commits"))
    return counts.where(F.col("commits") > 100)


WORDS = r"regexp_extract_all({0}, '\S+')"


@query(
    "a27_score_mean_std",
    f"""WITH s AS (SELECT len(list_intersect(list_distinct({WORDS.format('candidate')}), list_distinct({WORDS.format('reference')}))) AS k,
        len(list_distinct({WORDS.format('candidate')})) AS c, len(list_distinct({WORDS.format('reference')})) AS r
      FROM pair_texts WHERE reference IS NOT NULL)
    SELECT round(avg(k / c), 6) AS precision_mean, round(stddev_samp(k / c), 6) AS precision_std,
      round(avg(k / r), 6) AS recall_mean, round(stddev_samp(k / r), 6) AS recall_std,
      round(avg(2.0 * k / (c + r)), 6) AS f1_mean, round(stddev_samp(2.0 * k / (c + r)), 6) AS f1_std FROM s""",
    ("pair_texts",),
)
def a27(v: Views) -> DataFrame:
    scored = predictors.score_pairs(v.pair_texts(), "candidate", "reference")
    out = []
    for name in ("precision", "recall", "f1"):
        out += [F.avg(f"overlap_{name}").alias(f"{name}_mean"), F.stddev_samp(f"overlap_{name}").alias(f"{name}_std")]
    return tidy(scored.agg(*out))


@query(
    "a28_completeness",
    """SELECT count(*) AS rows, count(CASE WHEN trim(pr_body, ' ' || chr(10)) <> '' THEN 1 END) AS completed,
      round(count(CASE WHEN trim(pr_body, ' ' || chr(10)) <> '' THEN 1 END) / count(*), 6) AS share FROM bodies""",
    ("bodies",),
)
def a28(v: Views) -> DataFrame:
    generated = v.bodies().withColumn("summary", text.key_sentence(F.col("pr_body")))
    return tidy(predictors.completeness(generated, "summary"))


@query(
    "w1_task_type_shares",
    f"WITH {SHARES} SELECT *, round(num_prs / total_prs, 6) AS pr_rate FROM s",
    ("change_rows", "types_all"),
)
def w1(v: Views) -> DataFrame:
    return tidy(change_size.task_type_shares(_typed(v)))


@query(
    "w2_last_row_per_key",
    """SELECT is_agent, filename, pr_id FROM (SELECT *, row_number() OVER (PARTITION BY is_agent, filename ORDER BY pr_id DESC) AS rn
      FROM details_all) WHERE rn = 1""",
    ("details_all",),
)
def w2(v: Views) -> DataFrame:
    rows = v.all_details().select(change_size.is_agent(F.col("agent")).alias("is_agent"), "filename", "pr_id")
    return rows.groupBy("is_agent", "filename").agg(F.max("pr_id").alias("pr_id"))


@query(
    "w3_mid_ranks",
    f"""WITH {PER_PR} SELECT DISTINCT CAST(sum_changes AS DOUBLE) AS value,
      rank() OVER (ORDER BY sum_changes) + (count(*) OVER (PARTITION BY sum_changes) - 1) / 2.0 AS midrank FROM per_pr""",
    ROWS,
)
def w3(v: Views) -> DataFrame:
    from patchloom.operators.ranktests import rank_table

    prs = change_size.per_pr(v.change_table(), ["pr_id", "is_agent"])
    return rank_table(prs, [], "is_agent", [1, 0], "sum_changes").select("value", "midrank")
