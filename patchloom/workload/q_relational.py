"""Projection, recode, filter (P), joins (J), sort and sample (L), reshape (R), checks (Q)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import paths, times, vectors
from patchloom.operators import predictors, quality, reshape, sampling
from patchloom.plans import change_size, churn, features, textpairs
from patchloom.workload.common import tidy
from patchloom.workload.registry import query
from patchloom.workload.views import Views

D, P = ("details_all",), ("pr_all",)
DP = ("details_all", "pr_all")


# --- projection, recode, filter -------------------------------------------------------


@query("p01_projection", "SELECT pr_id, sha, filename, status, changes, additions, deletions FROM details_all", D)
def p01(v: Views) -> DataFrame:
    return change_size.agent_files(v.all_details())


@query(
    "p02_rename",
    "SELECT pr_id, sha, filename, status, changes, additions, deletions FROM details_all WHERE agent = 'Human'",
    D,
)
def p02(v: Views) -> DataFrame:
    return change_size.human_files(v.human_details()).toDF(
        "pr_id", "sha", "filename", "status", "changes", "additions", "deletions"
    )


@query("p03_drop_columns", "SELECT pr_id, pr_title FROM bodies", ("bodies",))
def p03(v: Views) -> DataFrame:
    return v.bodies().drop("pr_body")


@query(
    "p04_flags",
    """SELECT id AS pr_id, CASE WHEN merged_at IS NULL THEN 0 ELSE 1 END AS is_merged, is_agent FROM pr_all
    WHERE closed_at IS NOT NULL""",
    P,
)
def p04(v: Views) -> DataFrame:
    prs = change_size.closed_prs(v.all_prs())
    return prs.select("pr_id", "is_merged", change_size.is_agent(F.col("agent")).alias("is_agent"))


@query(
    "p05_constant_tag",
    "SELECT pr_id, filename, status, is_agent FROM details_all WHERE patch IS NOT NULL",
    D,
)
def p05(v: Views) -> DataFrame:
    return churn.patched_files(v.details(), v.human_details()).drop("patch")


@query(
    "p06_recode",
    """SELECT pr_id, CASE WHEN task_type IN ('build', 'chore') THEN 'build & chore'
      WHEN task_type IN ('test', 'docs') THEN 'test & docs' END AS task_type_new FROM types_all""",
    ("types_all",),
)
def p06(v: Views) -> DataFrame:
    types = change_size.task_types(v.agent_types(), v.human_types())
    kind = paths.recode(F.col("task_type"), change_size.MERGED_TASK_TYPES)
    return types.select("pr_id", kind.alias("task_type_new"))


@query("p07_not_null", "SELECT pr_id, sha FROM details_all WHERE patch IS NOT NULL AND message IS NOT NULL", D)
def p07(v: Views) -> DataFrame:
    kept = v.all_details().where(F.col("patch").isNotNull() & F.col("message").isNotNull())
    return kept.select("pr_id", "sha")


@query(
    "p08_compare_filters",
    "SELECT pr_id, sha, filename FROM details_all WHERE additions > 10 AND deletions > 3 AND status = 'added'",
    D,
)
def p08(v: Views) -> DataFrame:
    cond = (F.col("additions") > 10) & (F.col("deletions") > 3) & (F.col("status") == "added")
    return v.all_details().where(cond).select("pr_id", "sha", "filename")


@query(
    "p09_closed_interval",
    """SELECT id FROM pr_all WHERE CAST(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP)
      BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-01'""",
    P,
)
def p09(v: Views) -> DataFrame:
    created = times.parse_iso(F.col("created_at"))
    return v.all_prs().where(churn.between(created, "1997-01-01", "1998-06-01")).select("id")


@query("p10_status_list", "SELECT pr_id, filename FROM details_all WHERE status IN ('modified', 'removed')", D)
def p10(v: Views) -> DataFrame:
    return v.all_details().where(F.col("status").isin("modified", "removed")).select("pr_id", "filename")


@query("p11_point_lookup", "SELECT id, html_url FROM pr_all WHERE id = 123", P)
def p11(v: Views) -> DataFrame:
    return v.all_prs().where(F.col("id") == 123).select("id", "html_url")


@query(
    "p12_contains_element",
    """SELECT filename, lower(p) AS p, n FROM (SELECT filename, 'economy' AS p, count(*) AS n FROM details_all
      WHERE list_contains(string_split(filename, '/'), 'ECONOMY') OR list_contains(string_split(filename, '/'), 'Brand#1')
      GROUP BY filename)""",
    D,
)
def p12(v: Views) -> DataFrame:
    parts = F.split("filename", "/")
    kept = v.all_details().where(F.array_contains(parts, "ECONOMY") | F.array_contains(parts, "Brand#1"))
    return kept.groupBy("filename").agg(F.count("*").alias("n")).select("filename", F.lit("economy").alias("p"), "n")


@query(
    "p13_casts",
    "SELECT CAST(id AS VARCHAR) AS id, CAST(repo_id AS VARCHAR) AS repo_id, CAST(number AS INTEGER) AS number FROM pr_all",
    P,
)
def p13(v: Views) -> DataFrame:
    return v.all_prs().select(
        F.col("id").cast("string"), F.col("repo_id").cast("string"), F.col("number").cast("int")
    )


@query(
    "p14_fill_zero",
    """SELECT p.id AS pr_id, coalesce(n, 0) AS n, coalesce(title, '0') AS title FROM pr_all p LEFT JOIN
      (SELECT pr_id, count(*) AS n FROM details_all GROUP BY pr_id) d ON p.id = d.pr_id""",
    DP,
)
def p14(v: Views) -> DataFrame:
    counts = v.all_details().groupBy("pr_id").agg(F.count("*").alias("n"))
    prs = v.all_prs().select(F.col("id").alias("pr_id"), "title")
    return features.fill_zero(prs.join(counts, "pr_id", "left").select("pr_id", "n", "title"))


COS = """list_dot_product(CAST(l AS DOUBLE[]), CAST(r AS DOUBLE[])) /
  (sqrt(list_dot_product(CAST(l AS DOUBLE[]), CAST(l AS DOUBLE[]))) * sqrt(list_dot_product(CAST(r AS DOUBLE[]), CAST(r AS DOUBLE[]))))"""


@query(
    "p15_threshold_label",
    f"SELECT pr_id, CASE WHEN {COS} >= 0.2 THEN 1 ELSE 0 END AS label FROM vec_pairs",
    ("vec_pairs",),
)
def p15(v: Views) -> DataFrame:
    similarity = vectors.cosine(F.col("left_embedding"), F.col("right_embedding"))
    return v.embedding_pairs().select("pr_id", F.when(similarity >= 0.2, 1).otherwise(0).alias("label"))


@query(
    "p16_drop_null_rows",
    "SELECT pr_id, sha, message FROM commits WHERE message IS NOT NULL AND sha IS NOT NULL",
    ("commits",),
)
def p16(v: Views) -> DataFrame:
    return v.commits().dropna()


# The published patterns of template headings and issue links, as SQL reads them.
HEADING = (
    r"(?im)^(?:#+\s*|\s*|:)?(Description|Summary|Motivation|Context|Testing Steps|How to Test|Validation|Checklist|To-Do|Screenshots)\b"
)
ISSUE = (
    r"(?i)\b(?:closes|fixes|resolves|related to|issue links?|tickets?)(?:[:\s]+(?:#\d+|[A-Za-z]{2,}-\d+|[A-Za-z]+-\d+))"
)
TEMPLATE = f"""t AS (SELECT pr_id, pr_body, coalesce(regexp_matches(pr_body, '{ISSUE}'), false) AS linked,
    coalesce(len(list_distinct(regexp_extract_all(pr_body, '{HEADING}', 1))), 0) AS h, pr_body IS NOT NULL AS listed FROM bodies)"""


@query(
    "p17_template_score",
    f"""WITH {TEMPLATE} SELECT pr_id, round(CAST(linked AS INT) + h / (SELECT greatest(max(h), 1) FROM t)
      + CAST(listed AS INT), 6) AS pr_template_total_score FROM t""",
    ("bodies",),
)
def p17(v: Views) -> DataFrame:
    return tidy(features.template_features(v.bodies()).select("pr_id", "pr_template_total_score"))


@query(
    "p18_confident_english",
    "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND (n_chars % 100) / 100.0 > 0.7",
)
def p18(v: Views) -> DataFrame:
    docs = v.table("documents").select(
        "doc_id", "n_chars", F.col("lang").alias("language"), (F.col("n_chars") % 100 / 100.0).alias("confidence")
    )
    return predictors.confident_english(docs)


# --- joins ------------------------------------------------------------------------------


@query(
    "j01_inner_one_key",
    """SELECT p.id AS pr_id, p.agent, p.created_at, p.closed_at, p.merged_at, p.state,
      CASE WHEN p.merged_at IS NULL THEN 0 ELSE 1 END AS is_merged, sha, filename, status, changes, additions, deletions
    FROM pr_all p JOIN details_all d ON p.id = d.pr_id WHERE p.closed_at IS NOT NULL""",
    DP,
)
def j01(v: Views) -> DataFrame:
    return change_size.closed_prs(v.all_prs()).join(change_size.agent_files(v.all_details()), "pr_id")


@query(
    "j01_unmatched_count",
    """SELECT is_agent, count(*) AS closed_prs, count(*) FILTER (id NOT IN (SELECT pr_id FROM details_all WHERE status = 'added')) AS unmatched
    FROM pr_all WHERE closed_at IS NOT NULL GROUP BY is_agent""",
    DP,
)
def j01_unmatched(v: Views) -> DataFrame:
    """Closed pull requests that added no file."""
    added = v.all_details().where(F.col("status") == "added")
    return change_size.unmatched_prs(change_size.closed_prs(v.all_prs()), added)


@query(
    "j02_left_row_preserving",
    "SELECT id AS pr_id, state, task_type FROM pr_all LEFT JOIN types_all ON id = pr_id",
    ("pr_all", "types_all"),
)
def j02(v: Views) -> DataFrame:
    types = change_size.task_types(v.agent_types(), v.human_types())
    prs = v.all_prs().select(F.col("id").alias("pr_id"), "state")
    return change_size.add_task_type(prs, types)


LIFE = r"""named AS (SELECT pr_id, is_agent, filename, patch,
    CASE WHEN lower(regexp_extract(filename, '(\.[^./]*)$', 1)) IN ('.py', '.pyi') THEN 'python'
      WHEN regexp_extract(filename, '(\.[^./]*)$', 1) IN ('.ts', '.tsx') THEN 'typescript'
      WHEN filename LIKE '%.go' THEN 'go' END AS lang FROM details_all WHERE patch IS NOT NULL AND left(filename, 1) <> '.'),
  hits AS (SELECT pr_id, is_agent, lang, unnest(string_split(patch, chr(10))) AS line FROM named WHERE lang IS NOT NULL),
  defs AS (SELECT pr_id, is_agent, left(line, 1) AS sg, CASE
      WHEN lang = 'python' AND line[2:5] = 'def ' THEN trim(string_split(line[6:], '(')[1])
      WHEN lang = 'python' AND line[2:7] = 'class ' THEN trim(string_split(string_split(line[8:], '(')[1], ':')[1])
      WHEN lang = 'typescript' AND line[2:10] = 'function ' THEN trim(string_split(line[11:], '(')[1])
      WHEN lang = 'typescript' AND line[2:7] = 'const ' AND contains(line, '=>') THEN trim(string_split(line[8:], '=')[1])
      WHEN lang = 'typescript' AND line[2:5] = 'let ' AND contains(line, '=>') THEN trim(string_split(line[6:], '=')[1])
      WHEN lang = 'typescript' AND line[2:7] = 'class ' THEN trim(string_split(line[8:], '{')[1])
      WHEN lang = 'go' AND line[2:6] = 'func ' THEN trim(string_split(line[7:], '(')[1]) END AS name FROM hits),
  ev AS (SELECT pr_id, is_agent, name, max(CAST(sg = '+' AS INT)) AS a, max(CAST(sg = '-' AS INT)) AS r
    FROM defs WHERE sg IN ('+', '-') AND name <> '' GROUP BY ALL),
  net AS (SELECT e.pr_id, e.is_agent, name, a = 1 AND r = 0 AS ia, r = 1 AS ir, merged_ts AS ts,
      CASE WHEN e.is_agent = 1 THEN CAST(repo_id AS VARCHAR) ELSE string_split(repo_url, '/')[-2] || '/' || string_split(repo_url, '/')[-1] END AS repo
    FROM ev e JOIN pr_all p ON p.id = e.pr_id WHERE merged_at IS NOT NULL),
  fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr_id, ts) AS rn FROM net WHERE ia) WHERE rn = 1),
  fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pr_id, ts) AS rn FROM net WHERE ir) WHERE rn = 1),
  life AS (SELECT fa.repo AS repo_id, fa.pr_id AS added_pr_id, fa.ts AS added_ts, fa.name AS func_class, fa.is_agent,
      fr.pr_id AS removed_pr_id, fr.ts AS removed_ts, CASE WHEN fr.pr_id IS NULL THEN 0 ELSE 1 END AS is_removed
    FROM fa LEFT JOIN fr ON fa.name = fr.name AND fa.repo = fr.repo AND fa.pr_id <> fr.pr_id AND fa.ts < fr.ts)"""


def lifetimes_of(v: Views, typed: bool = False) -> DataFrame:
    types = change_size.task_types(v.agent_types(), v.human_types()) if typed else None
    return churn.definition_lifetimes(v.pr(), v.details(), v.human_pr(), v.human_details(), types)


@query(
    "j03_left_other_key_name",
    f"WITH {LIFE} SELECT l.added_pr_id, func_class, p.state FROM life l LEFT JOIN pr_all p ON l.added_pr_id = p.id",
    DP,
)
def j03(v: Views) -> DataFrame:
    life = lifetimes_of(v).select("added_pr_id", "func_class")
    prs = v.all_prs().select(F.col("id").alias("added_pr_id"), "state")
    return life.join(prs, "added_pr_id", "left")


@query(
    "j04_dimension_in_two_roles",
    f"""WITH {LIFE} SELECT func_class, added_pr_id, removed_pr_id, a.task_type AS added_task_type, r.task_type AS removed_task_type,
      strftime(added_ts, '%Y-%m') AS added_batch
    FROM life LEFT JOIN types_all a ON a.pr_id = added_pr_id LEFT JOIN types_all r ON r.pr_id = removed_pr_id""",
    (*DP, "types_all"),
)
def j04(v: Views) -> DataFrame:
    return lifetimes_of(v, typed=True).select(
        "func_class", "added_pr_id", "removed_pr_id", "added_task_type", "removed_task_type", "added_batch"
    )


@query(
    "j05_composite_key",
    """SELECT a.pr_id, a.filename, a.n, b.m FROM (SELECT pr_id, filename, count(*) AS n FROM details_all WHERE status = 'added' GROUP BY ALL) a
    JOIN (SELECT pr_id, filename, count(*) AS m FROM details_all WHERE status = 'removed' GROUP BY ALL) b USING (pr_id, filename)""",
    D,
)
def j05(v: Views) -> DataFrame:
    def counts(status: str, name: str) -> DataFrame:
        rows = v.all_details().where(F.col("status") == status)
        return rows.groupBy("pr_id", "filename").agg(F.count("*").alias(name))

    return counts("added", "n").join(counts("removed", "m"), ["pr_id", "filename"])


FIRSTS = """t AS (SELECT d.filename, d.pr_id, p.merged_ts AS ts, d.status FROM details_all d JOIN pr_all p ON p.id = d.pr_id WHERE merged_at IS NOT NULL),
  a AS (SELECT filename, min(pr_id) AS added_pr, arg_min(ts, pr_id) AS added_ts FROM t WHERE status = 'added' GROUP BY filename),
  r AS (SELECT filename, max(pr_id) AS removed_pr, arg_max(ts, pr_id) AS removed_ts FROM t WHERE status = 'removed' GROUP BY filename)"""


def _first_last(v: Views) -> tuple[DataFrame, DataFrame]:
    merged = v.all_prs().where(F.col("merged_at").isNotNull()).select(
        F.col("id").alias("pr_id"), times.parse_iso(F.col("merged_at")).alias("ts")
    )
    rows = v.all_details().select("pr_id", "filename", "status").join(merged, "pr_id")
    added = rows.where(F.col("status") == "added").groupBy("filename").agg(F.min(F.struct("pr_id", "ts")).alias("a"))
    gone = rows.where(F.col("status") == "removed").groupBy("filename").agg(F.max(F.struct("pr_id", "ts")).alias("r"))
    return (
        added.select("filename", F.col("a.pr_id").alias("added_pr"), F.col("a.ts").alias("added_ts")),
        gone.select("filename", F.col("r.pr_id").alias("removed_pr"), F.col("r.ts").alias("removed_ts")),
    )


@query(
    "j06_equi_with_residual",
    f"""WITH {FIRSTS} SELECT a.filename, added_pr, removed_pr FROM a JOIN r ON a.filename = r.filename
      AND added_pr <> removed_pr AND added_ts < removed_ts""",
    DP,
)
def j06(v: Views) -> DataFrame:
    added, gone = _first_last(v)
    on = (
        (added["filename"] == gone["filename"])
        & (F.col("added_pr") != F.col("removed_pr"))
        & (F.col("added_ts") < F.col("removed_ts"))
    )
    return added.join(gone, on).select(added["filename"], "added_pr", "removed_pr")


@query(
    "j07_left_three_keys",
    """SELECT d.pr_id, d.sha, d.filename, n FROM (SELECT DISTINCT pr_id, sha, filename FROM details_all) d LEFT JOIN
      (SELECT pr_id, sha, filename, count(*) AS n FROM details_all WHERE status = 'modified' GROUP BY ALL) m
      USING (pr_id, sha, filename)""",
    D,
)
def j07(v: Views) -> DataFrame:
    keys = ["pr_id", "sha", "filename"]
    base = v.all_details().select(*keys).distinct()
    changed = v.all_details().where(F.col("status") == "modified").groupBy(*keys).agg(F.count("*").alias("n"))
    return base.join(changed, keys, "left")


@query(
    "j08_left_sha_group",
    """WITH lab AS (SELECT DISTINCT sha, is_agent, message AS label_message FROM details_all WHERE patch IS NOT NULL
        UNION ALL SELECT DISTINCT hash, 2, message FROM corpus),
      g AS (SELECT DISTINCT sha, is_agent FROM details_all UNION ALL SELECT DISTINCT hash, 2 FROM corpus)
    SELECT g.sha, g.is_agent, label_message FROM g LEFT JOIN lab USING (sha, is_agent)""",
    ("details_all", "corpus"),
)
def j08(v: Views) -> DataFrame:
    labels = textpairs.true_messages(v.details(), v.human_details(), v.corpus())
    agents = v.all_details().select("sha", change_size.is_agent(F.col("agent")).alias("is_agent")).distinct()
    bench = v.corpus().select(F.col("hash").alias("sha"), F.lit(2).alias("is_agent")).distinct()
    return textpairs.attach_true_messages(agents.unionByName(bench), labels)


@query(
    "j09_semi_on_group_size",
    """SELECT hash, diff_languages FROM corpus WHERE diff_languages IN
      (SELECT diff_languages FROM corpus GROUP BY diff_languages HAVING count(DISTINCT hash) > 200)""",
    ("corpus",),
)
def j09(v: Views) -> DataFrame:
    rows = v.corpus().select("hash", "diff_languages")
    large = rows.groupBy("diff_languages").agg(F.count_distinct("hash").alias("n")).where(F.col("n") > 200)
    return rows.join(large, "diff_languages", "left_semi")


@query(
    "j10_anti_join",
    "SELECT pr_id, sha, filename FROM details_all WHERE sha NOT IN (SELECT sha FROM details_all WHERE patch IS NULL)",
    D,
)
def j10(v: Views) -> DataFrame:
    return textpairs.fully_patched(v.all_details()).select("pr_id", "sha", "filename")


W = r"regexp_extract_all({0}, '\S+')"
OVERLAP = f"""len(list_intersect(list_distinct({W.format('candidate')}), list_distinct({W.format('reference')}))) AS k,
  len(list_distinct({W.format('candidate')})) AS c, len(list_distinct({W.format('reference')})) AS r"""


@query(
    "j11_scores_joined_back",
    f"""WITH s AS (SELECT candidate, reference, count(*) AS pair_rows, {OVERLAP} FROM pair_texts
        WHERE candidate IS NOT NULL AND reference IS NOT NULL GROUP BY candidate, reference)
    SELECT p.conv_id, p.turn, p.candidate, p.reference, s.pair_rows, round(k / c, 6) AS overlap_precision, round(k / r, 6) AS overlap_recall,
      round(2.0 * k / (c + r), 6) AS overlap_f1 FROM pair_texts p LEFT JOIN s USING (candidate, reference)""",
    ("pair_texts",),
)
def j11(v: Views) -> DataFrame:
    return tidy(predictors.score_distinct_pairs(v.pair_texts(), "candidate", "reference"))


@query(
    "j12_latest_add_with_latest_change",
    f"""WITH {FIRSTS} SELECT a.filename, added_pr, removed_pr FROM a JOIN r ON a.filename = r.filename WHERE removed_ts > added_ts""",
    DP,
)
def j12(v: Views) -> DataFrame:
    added, gone = _first_last(v)
    on = (added["filename"] == gone["filename"]) & (F.col("removed_ts") > F.col("added_ts"))
    return added.join(gone, on).select(added["filename"], "added_pr", "removed_pr")


# --- sort, limit, sample ------------------------------------------------------------------


@query("l1_multi_key_sort", "SELECT id, state, repo_id FROM pr_all ORDER BY state DESC, repo_id, id DESC", P)
def l1(v: Views) -> DataFrame:
    return v.all_prs().select("id", "state", "repo_id").orderBy(F.desc("state"), "repo_id", F.desc("id"))


@query("l2_head", "SELECT id, state FROM pr_all ORDER BY id LIMIT 7", P)
def l2(v: Views) -> DataFrame:
    return v.all_prs().select("id", "state").orderBy("id").limit(7)


@query(
    "l3_top_k",
    "SELECT filename, n FROM (SELECT filename, count(*) AS n FROM details_all GROUP BY filename) ORDER BY n DESC, filename LIMIT 5",
    D,
)
def l3(v: Views) -> DataFrame:
    counts = v.all_details().groupBy("filename").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "filename").limit(5)


@query(
    "l4_argmax",
    """SELECT arg_max(pr_id, (n, pr_id)) AS pr_id, max(n) AS n FROM (SELECT pr_id, sum(changes)::BIGINT AS n FROM details_all GROUP BY pr_id)""",
    D,
)
def l4(v: Views) -> DataFrame:
    sums = v.all_details().groupBy("pr_id").agg(F.sum("changes").alias("n"))
    return sums.agg(F.max_by("pr_id", F.struct("n", "pr_id")).alias("pr_id"), F.max("n").alias("n"))


@query("l5_threshold_positions", f"SELECT pr_id FROM vec_pairs WHERE {COS} >= 0.1", ("vec_pairs",))
def l5(v: Views) -> DataFrame:
    similarity = vectors.cosine(F.col("left_embedding"), F.col("right_embedding"))
    return v.embedding_pairs().where(similarity >= 0.1).select("pr_id")


@query(
    "l6_fixed_sample",
    "SELECT id, state FROM pr_all ORDER BY md5(id || '|42'), id LIMIT 605",
    P,
)
def l6(v: Views) -> DataFrame:
    return sampling.sample_n(v.all_prs().select("id", "state"), 605, ["id"])


@query(
    "l7_fraction_sample",
    """SELECT id, state FROM (SELECT id, state, row_number() OVER (ORDER BY md5(id || '|42'), id) AS rn, count(*) OVER () AS n FROM pr_all)
    WHERE rn <= round_even(0.05 * n, 0)""",
    P,
)
def l7(v: Views) -> DataFrame:
    return sampling.sample_fraction(v.all_prs().select("id", "state"), 0.05, ["id"])


@query(
    "l8_stratified_fraction",
    """SELECT hash, diff_languages FROM (SELECT hash, diff_languages, count(*) OVER (PARTITION BY diff_languages) AS n,
      row_number() OVER (PARTITION BY diff_languages ORDER BY md5(hash || '|42'), hash) AS rn FROM corpus) WHERE rn <= round_even(0.05 * n, 0)""",
    ("corpus",),
)
def l8(v: Views) -> DataFrame:
    rows = v.corpus().select("hash", "diff_languages")
    return sampling.sample_fraction(rows, 0.05, ["hash"], ["diff_languages"])


@query(
    "l9_fixed_per_group",
    """SELECT id, is_agent FROM (SELECT id, is_agent, row_number() OVER (PARTITION BY is_agent ORDER BY md5(id || '|42'), id) AS rn FROM pr_all)
    WHERE rn <= CASE is_agent WHEN 0 THEN 605 ELSE 653 END""",
    P,
)
def l9(v: Views) -> DataFrame:
    rows = v.all_prs().select("id", change_size.is_agent(F.col("agent")).alias("is_agent"))
    return sampling.sample_n_per_group(rows, "is_agent", {0: 605, 1: 653}, ["id"])


# --- reshape ---------------------------------------------------------------------------------


@query(
    "r1_union_by_name",
    "SELECT id, state, agent FROM pr_all",
    P,
)
def r1(v: Views) -> DataFrame:
    return v.pr().select("id", "state", "agent").unionByName(v.human_pr().select("agent", "id", "state"))


def _name_lists(v: Views) -> DataFrame:
    """Words of a turn and of the turn before it."""
    return v.pair_texts().select(
        "conv_id",
        "turn",
        F.split("candidate", " ").alias("added"),
        F.coalesce(F.split("reference", " "), F.array().cast("array<string>")).alias("removed"),
    )


@query(
    "r2_list_difference",
    """SELECT conv_id, turn, list_aggregate(list_filter(string_split(candidate, ' '),
      lambda x: NOT list_contains(coalesce(string_split(reference, ' '), []), x)), 'string_agg', ' ') AS kept FROM pair_texts""",
    ("pair_texts",),
)
def r2(v: Views) -> DataFrame:
    lists = _name_lists(v)
    kept = reshape.without(F.col("added"), F.col("removed"))
    return lists.select("conv_id", "turn", F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("kept"))


@query(
    "r3_list_overlap",
    """SELECT conv_id, turn, list_has_any(string_split(candidate, ' '), coalesce(string_split(reference, ' '), [])) AS clash FROM pair_texts""",
    ("pair_texts",),
)
def r3(v: Views) -> DataFrame:
    return _name_lists(v).select("conv_id", "turn", reshape.overlaps(F.col("added"), F.col("removed")).alias("clash"))


@query(
    "r4_explode_lists",
    "SELECT conv_id, turn, unnest(string_split(reference, ' ')) AS word FROM pair_texts WHERE reference IS NOT NULL",
    ("pair_texts",),
)
def r4(v: Views) -> DataFrame:
    return reshape.explode_names(_name_lists(v).drop("added"), "removed", "word")


@query(
    "r5_melt",
    """SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS value
    FROM lineitem""",
)
def r5(v: Views) -> DataFrame:
    return reshape.melt(
        v.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value"
    )


@query(
    "r6_unstack",
    """SELECT repo_id, nullif(count(*) FILTER (state = 'F'), 0) AS "F", nullif(count(*) FILTER (state = 'O'), 0) AS "O",
      nullif(count(*) FILTER (state = 'P'), 0) AS "P" FROM pr_all GROUP BY repo_id""",
    P,
)
def r6(v: Views) -> DataFrame:
    return v.all_prs().groupBy("repo_id").pivot("state", ["F", "O", "P"]).count()


@query(
    "r7_one_hot",
    """SELECT pr_id, CAST(coalesce(task_type = 'build', false) AS INT) AS task_type_build, CAST(coalesce(task_type = 'chore', false) AS INT) AS task_type_chore,
      CAST(coalesce(task_type = 'docs', false) AS INT) AS task_type_docs, CAST(coalesce(task_type = 'feat', false) AS INT) AS task_type_feat,
      CAST(coalesce(task_type = 'fix', false) AS INT) AS task_type_fix, CAST(coalesce(task_type = 'test', false) AS INT) AS task_type_test FROM types_all""",
    ("types_all",),
)
def r7(v: Views) -> DataFrame:
    return reshape.one_hot(change_size.task_types(v.agent_types(), v.human_types()), "task_type", ["build", "chore", "docs", "feat", "fix", "test"])


# --- data checks -----------------------------------------------------------------------------


@query(
    "q1_repeated_keys",
    "SELECT pr_id, sha, count(*) AS rows FROM details_all GROUP BY pr_id, sha HAVING count(*) > 1",
    D,
)
def q1(v: Views) -> DataFrame:
    return quality.repeated_keys(v.all_details(), ["pr_id", "sha"])


@query(
    "q2_row_preserving_dimension",
    "SELECT id AS pr_id, count(*) AS rows FROM pr_all GROUP BY id HAVING count(*) > 1",
    P,
)
def q2(v: Views) -> DataFrame:
    """The keys that would break a left join on the pull-request table: none."""
    return quality.repeated_keys(v.all_prs().select(F.col("id").alias("pr_id")), ["pr_id"])


@query(
    "q2_row_multiplying_dimension",
    "SELECT pr_id, count(*) AS rows FROM related GROUP BY pr_id HAVING count(*) > 1",
    ("related",),
)
def q2_multiplying(v: Views) -> DataFrame:
    """Keys whose left join on related issues would multiply rows."""
    return quality.repeated_keys(v.related_issues(), ["pr_id"])


@query(
    "q3_null_counts",
    "SELECT count(*) - count(patch) AS patch, count(*) - count(message) AS message, count(*) - count(sha) AS sha FROM details_all",
    D,
)
def q3(v: Views) -> DataFrame:
    return quality.null_counts(v.all_details(), ["patch", "message", "sha"])


@query("q4_required_columns", "SELECT count(*) AS rows FROM commits", ("commits",))
def q4(v: Views) -> DataFrame:
    return quality.require_columns(v.commits(), ["pr_id", "sha", "message"]).agg(F.count("*").alias("rows"))


@query("q5_bound", "SELECT max(additions) AS largest, max(additions) < 51 AS within FROM details_all", D)
def q5(v: Views) -> DataFrame:
    top = v.all_details().agg(F.max("additions").alias("largest"))
    return top.select("largest", (F.col("largest") < 51).alias("within"))
