"""Tests (T), composite analyses and classification (C), churn rate (A25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import times, vectors
from patchloom.operators import cumulative, normality, ranktests
from patchloom.plans import attribution, boosting, change_size, churn, classify, features, kernel, textpairs
from patchloom.plans.exact_neighbours import exact_vote
from patchloom.plans.neighbours import knn_vote
from patchloom.session import materialize, release
from patchloom.workload.common import describe_sql, mann_whitney_sql, tidy, two_sided_sql
from patchloom.workload.q_aggregates import PER_PR
from patchloom.workload.q_relational import COS, HEADING, ISSUE, LIFE, lifetimes_of
from patchloom.workload.registry import ORACLES, query
from patchloom.workload.views import Views

DP = ("details_all", "pr_all")
ROWS = ("change_rows",)


@query(
    "a25_churn_rates",
    f"""WITH {LIFE} SELECT is_agent, strftime(added_ts, '%Y-%m') AS added_batch, count(DISTINCT func_class) AS definitions,
      count(DISTINCT CASE WHEN is_removed = 1 THEN func_class END) AS removed_definitions,
      round(count(DISTINCT CASE WHEN is_removed = 1 THEN func_class END) / count(DISTINCT func_class), 6) AS churn_rate FROM life GROUP BY ALL""",
    DP,
)
def a25(v: Views) -> DataFrame:
    life = lifetimes_of(v).withColumn("added_batch", times.year_month(F.col("added_at_dt")))
    return tidy(churn.churn_rates(life, ["is_agent", "added_batch"]))


# --- significance tests --------------------------------------------------------------------

TALL = f"""{PER_PR}, tall AS (SELECT CASE is_agent WHEN 1 THEN 'APR' ELSE 'HPR' END AS grp,
    unnest(['num_commits', 'sum_changes', 'num_file_changes', 'num_module_l1']) AS metric,
    unnest([num_commits, sum_changes, num_file_changes, num_module_l1]) AS value FROM per_pr)"""


def _nest(prefix: str, body: str) -> str:
    """Put CTEs in front of a statement that starts with WITH."""
    return f"WITH {prefix}, {body.strip()[5:]}"


@query(
    "t1_mann_whitney",
    _nest(TALL, mann_whitney_sql("metric", "grp", "value", "'APR'", "'HPR'", "tall")),
    ROWS,
)
def t1(v: Views) -> DataFrame:
    prs = change_size.pr_level(v.change_table())
    tall = cumulative.stack_metrics(prs, ["Group"], change_size.SCOPE_METRICS)
    tested = ranktests.mann_whitney(tall, "Group", "value", "APR", "HPR", ["metric"])
    return tidy(tested)


@query(
    "t1_small_samples",
    """WITH RECURSIVE bal AS (SELECT s_nationkey AS nation, 'S' AS g, s_acctbal AS v FROM supplier UNION ALL SELECT c_nationkey, 'C', c_acctbal FROM customer),
      rk AS (SELECT *, rank() OVER (PARTITION BY nation ORDER BY v) AS r, count(*) OVER (PARTITION BY nation, v) AS t FROM bal),
      u AS (SELECT nation, count(*) FILTER (g = 'S') AS a, count(*) FILTER (g = 'C') AS b, sum(r) FILTER (g = 'S') - count(*) FILTER (g = 'S') * (count(*) FILTER (g = 'S') + 1) // 2 AS u1
        FROM rk GROUP BY nation HAVING max(t) = 1 AND least(count(*) FILTER (g = 'S'), count(*) FILTER (g = 'C')) BETWEEN 1 AND 8),
      sizes AS (SELECT DISTINCT least(a, b) AS k, a + b AS n FROM u),
      ways(k, n, i, taken, s, c) AS (SELECT k, n, 0, 0, CAST(0 AS BIGINT), CAST(1 AS HUGEINT) FROM sizes UNION ALL
        SELECT k, n, i + 1, taken + x, s + x * (i + 1), CAST(sum(c) AS HUGEINT) FROM ways, (VALUES (0), (1)) AS pick(x) WHERE i < n AND taken + x <= k GROUP BY ALL),
      dist AS (SELECT k, n, s - k * (k + 1) // 2 AS u, c FROM ways WHERE i = n AND taken = k)
    SELECT nation, a AS n_first, b AS n_second, CAST(u1 AS DOUBLE) AS u_stat,
      round(least(1.0, CAST(2 * sum(c) FILTER (u >= greatest(u1, a * b - u1)) AS DOUBLE) / CAST(sum(c) AS DOUBLE)), 6) AS p_value,
      least(1.0, CAST(2 * sum(c) FILTER (u >= greatest(u1, a * b - u1)) AS DOUBLE) / CAST(sum(c) AS DOUBLE)) < 0.05 AS significant
    FROM u JOIN dist ON dist.k = least(a, b) AND dist.n = a + b GROUP BY nation, a, b, u1""",
)
def t1_small(v: Views) -> DataFrame:
    """Account balances of suppliers against customers by nation, where one side is so small and without ties that p is exact."""
    both = v.table("supplier").select(F.col("s_nationkey").alias("nation"), F.lit("S").alias("g"), F.col("s_acctbal").alias("v"))
    both = both.unionByName(v.table("customer").select(F.col("c_nationkey").alias("nation"), F.lit("C").alias("g"), F.col("c_acctbal").alias("v")))
    tied = both.groupBy("nation", "v").count().groupBy("nation").agg(F.max("count").alias("most"))
    tested = ranktests.mann_whitney(both, "g", "v", "S", "C", ["nation"]).join(tied, "nation")
    return tidy(tested.where((F.col("most") == 1) & F.least("n_first", "n_second").between(1, ranktests.EXACT_SIZE)).drop("z_stat", "most"))


GROUPED = f"""{PER_PR}, g AS (SELECT CASE agent WHEN 'Human' THEN 'HPR' WHEN '5-LOW' THEN 'APR' ELSE 'Benchmark' END AS grp, sum_changes AS value
    FROM per_pr JOIN (SELECT DISTINCT pr_id, agent FROM change_rows) USING (pr_id) WHERE agent IN ('Human', '5-LOW', '4-NOT SPECIFIED')),
  rk AS (SELECT grp, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS mr, count(*) OVER (PARTITION BY value) AS t FROM g),
  s AS (SELECT grp, count(*) AS n, sum(mr) AS r FROM rk GROUP BY grp),
  tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM rk),
  kw AS (SELECT (12.0 / (tot.n * (tot.n + 1)) * (SELECT sum(CAST(r AS DOUBLE) * r / n) FROM s) - 3 * (tot.n + 1)) / (1 - ties / (tot.n ** 3 - tot.n)) AS h FROM tot)"""


def _three_groups(v: Views) -> DataFrame:
    rows = v.change_table().where(F.col("agent").isin("Human", "5-LOW", "4-NOT SPECIFIED"))
    group = F.when(F.col("agent") == "Human", "HPR").when(F.col("agent") == "5-LOW", "APR").otherwise("Benchmark")
    return change_size.per_pr(rows.withColumn("grp", group), ["pr_id", "grp"])


LABELS = ["HPR", "APR", "Benchmark"]


@query(
    "t2_kruskal_wallis",
    f"""WITH {GROUPED} SELECT CAST(tot.n AS BIGINT) AS size, round(h, 6) AS h_stat, round(exp(-h / 2), 6) AS p_value FROM kw, tot""",
    ROWS,
)
def t2(v: Views) -> DataFrame:
    tested = ranktests.kruskal(_three_groups(v), "grp", "sum_changes", LABELS)
    return tidy(tested.select("size", "h_stat", "p_value"))


@query(
    "t3_dunn_pairs",
    f"""WITH {GROUPED}, z AS (SELECT a.grp AS first, b.grp AS second, (a.r / a.n - b.r / b.n) /
      sqrt((tot.n * (tot.n + 1) / 12 - ties / (12 * (tot.n - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z FROM s a, s b, tot
      WHERE (a.grp, b.grp) IN (('HPR', 'APR'), ('HPR', 'Benchmark'), ('APR', 'Benchmark'))),
      p AS (SELECT *, {two_sided_sql("z")} AS p FROM z), o AS (SELECT *, row_number() OVER (ORDER BY p, first, second) AS i FROM p),
      h AS (SELECT *, least(1.0, max(p * (4 - i)) OVER (ORDER BY i)) AS holm FROM o)
    SELECT g.gate, first, second, round(z, 6) AS z_stat, round(p, 6) AS p_raw, round(holm, 6) AS p_holm
    FROM h, (VALUES (1.0, 'always'), (0.05, '0.05')) AS g(alpha, gate), kw WHERE alpha = 1.0 OR exp(-kw.h / 2) < alpha""",
    ROWS,
)
def t3(v: Views) -> DataFrame:
    """All pairs, and the pairs of a test that runs only below 0.05."""
    rows = _three_groups(v)
    always = ranktests.dunn_holm(rows, "grp", "sum_changes", LABELS, alpha=None).withColumn("gate", F.lit("always"))
    gated = ranktests.dunn_holm(rows, "grp", "sum_changes", LABELS, alpha=0.05).withColumn("gate", F.lit("0.05"))
    return tidy(always.unionByName(gated))


@query(
    "t4_two_proportions",
    f"""WITH {LIFE}, c AS (SELECT count(DISTINCT CASE WHEN is_agent = 0 AND is_removed = 1 THEN func_class END) AS h1, count(DISTINCT CASE WHEN is_agent = 0 THEN func_class END) AS t1,
      count(DISTINCT CASE WHEN is_agent = 1 AND is_removed = 1 THEN func_class END) AS h2, count(DISTINCT CASE WHEN is_agent = 1 THEN func_class END) AS t2 FROM life)
    SELECT h1 AS hits_first, t1 AS trials_first, h2 AS hits_second, t2 AS trials_second,
      round(z, 6) AS z_stat, round({two_sided_sql("z")}, 6) AS p_value
    FROM (SELECT *, (h1 / t1 - h2 / t2) / sqrt((h1 + h2) / (t1 + t2) * (1 - (h1 + h2) / (t1 + t2)) * (1 / t1 + 1 / t2)) AS z FROM c)""",
    DP,
)
def t4(v: Views) -> DataFrame:
    tested = ranktests.proportion_test(lifetimes_of(v), "is_agent", 0, 1, F.col("is_removed") == 1, "func_class")
    return tidy(tested)


@query(
    "t5_normality",
    f"""WITH {PER_PR}, m AS (SELECT is_agent, count(*) AS n, avg(sum_changes) AS mu FROM per_pr GROUP BY is_agent),
      c AS (SELECT is_agent, n, avg((sum_changes - mu) ** 2) AS m2, avg((sum_changes - mu) ** 3) AS m3, avg((sum_changes - mu) ** 4) AS m4
        FROM per_pr JOIN m USING (is_agent) GROUP BY ALL)
    SELECT is_agent, n AS count, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis,
      round(n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 6) AS jb_stat,
      round(exp(-n / 12.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4)), 6) AS p_value FROM c""",
    ROWS,
)
def t5(v: Views) -> DataFrame:
    prs = change_size.per_pr(v.change_table(), ["pr_id", "is_agent"])
    return tidy(ranktests.jarque_bera(prs, ["is_agent"], "sum_changes"))


# --- features ------------------------------------------------------------------------------

FEATURES = rf"""b AS (SELECT pr_id, len(regexp_extract_all(pr_title, '\S+')) AS pr_title_length, len(regexp_extract_all(pr_body, '\S+')) AS pr_body_length,
    coalesce(regexp_matches(pr_body, '{ISSUE}'), false) AS linked, coalesce(len(list_distinct(regexp_extract_all(pr_body, '{HEADING}', 1))), 0) AS h,
    pr_body IS NOT NULL AS listed, coalesce(contains(pr_body, '```'), false) AS contains_code_snippets FROM bodies),
  iss AS (SELECT pr_id, count(issue_id) AS number_of_related_issues FROM related GROUP BY pr_id),
  com AS (SELECT pr_id, count(sha) AS number_of_commits, sum(len(regexp_extract_all(message, '\S+'))) / count(sha) AS avg_commit_message_length FROM commits GROUP BY pr_id),
  sc AS (SELECT pr_id, count(DISTINCT filename) AS number_of_files_changed, sum(additions)::BIGINT AS total_addition, sum(deletions)::BIGINT AS total_deletion,
    sum(changes)::BIGINT AS total_changes, nullif(count(DISTINCT CASE WHEN status = 'added' THEN filename END), 0) AS added,
    nullif(count(DISTINCT CASE WHEN status = 'removed' THEN filename END), 0) AS removed,
    nullif(count(DISTINCT CASE WHEN status = 'modified' THEN filename END), 0) AS modified,
    count(DISTINCT CASE WHEN len(string_split(filename, '/')) >= 2 THEN string_split(filename, '/')[-2] END) AS number_of_modules_l1_changed
    FROM details_all GROUP BY pr_id),
  f AS (SELECT b.pr_id, pr_title_length, pr_body_length, linked, h / (SELECT greatest(max(h), 1) FROM b) AS hs, listed,
    CAST(linked AS INT) + h / (SELECT greatest(max(h), 1) FROM b) + CAST(listed AS INT) AS pr_template_total_score, contains_code_snippets, task_type,
    number_of_related_issues, number_of_commits, avg_commit_message_length, number_of_files_changed, total_addition, total_deletion, total_changes,
    added, removed, modified, number_of_modules_l1_changed
    FROM b LEFT JOIN types_all USING (pr_id) LEFT JOIN iss USING (pr_id) LEFT JOIN com USING (pr_id) LEFT JOIN sc USING (pr_id))"""
FEATURE_VIEWS = ("bodies", "related", "commits", "details_all", "types_all")
STATUS_COLUMNS = ("added", "removed", "modified")
CATEGORIES = ("0", "build", "chore", "docs", "feat", "fix", "test")


def _features(v: Views) -> DataFrame:
    types = change_size.task_types(v.agent_types(), v.human_types())
    return features.build_features(
        v.bodies(), types, v.related_issues(), v.commits(), v.all_details(), STATUS_COLUMNS
    )


@query(
    "c01_feature_table",
    f"""WITH {FEATURES} SELECT pr_id, pr_title_length, pr_body_length, linked AS contains_issue_task_linking, round(hs, 6) AS common_template_heading_score,
      listed AS contains_checklist_items, round(pr_template_total_score, 6) AS pr_template_total_score, contains_code_snippets, task_type, number_of_related_issues,
      number_of_commits, round(avg_commit_message_length, 6) AS avg_commit_message_length, number_of_files_changed, total_addition, total_deletion, total_changes,
      added, removed, modified, number_of_modules_l1_changed FROM f""",
    FEATURE_VIEWS,
)
def c01(v: Views) -> DataFrame:
    return tidy(_features(v).drop("pr_title", "pr_body"))


def _similarity(v: Views) -> DataFrame:
    return v.embedding_pairs().select(
        "pr_id", vectors.cosine(F.col("left_embedding"), F.col("right_embedding")).alias("similarity")
    )


@query(
    "c02_labelled_matrix",
    f"""WITH {FEATURES} SELECT f.pr_id, coalesce(pr_title_length, 0) AS pr_title_length, coalesce(pr_body_length, 0) AS pr_body_length,
      round(pr_template_total_score, 6) AS pr_template_total_score, CAST(contains_code_snippets AS INT) AS contains_code_snippets,
      coalesce(number_of_related_issues, 0) AS number_of_related_issues, coalesce(number_of_commits, 0) AS number_of_commits,
      round(coalesce(avg_commit_message_length, 0), 6) AS avg_commit_message_length, coalesce(number_of_files_changed, 0) AS number_of_files_changed,
      coalesce(total_addition, 0) AS total_addition, coalesce(total_deletion, 0) AS total_deletion, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
      coalesce(modified, 0) AS modified, coalesce(number_of_modules_l1_changed, 0) AS number_of_modules_l1_changed,
      CASE WHEN {COS} >= 0.1 THEN 1 ELSE 0 END AS label, {", ".join(f"CAST(coalesce(task_type, '0') = '{c}' AS INT) AS task_type_{c}" for c in CATEGORIES)}
    FROM f JOIN vec_pairs USING (pr_id)""",
    (*FEATURE_VIEWS, "vec_pairs"),
)
def c02(v: Views) -> DataFrame:
    return tidy(features.labelled_matrix(_features(v), _similarity(v), 0.1, CATEGORIES))


@query(
    "c03_stratified_split",
    """SELECT doc_id AS pr_id, quality AS label, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42'), doc_id)
      <= round_even(0.2 * count(*) OVER (PARTITION BY quality), 0) THEN 1 ELSE 0 END AS is_test FROM labels""",
)
def c03(v: Views) -> DataFrame:
    rows = v.table("labels").select(F.col("doc_id").alias("pr_id"), F.col("quality").alias("label"))
    return classify.split(rows)


C02_MATRIX = ORACLES["c02_labelled_matrix"]


def _matrix(v: Views) -> DataFrame:
    """The labelled feature table with its split, to six digits as its own query gives it."""
    rows = materialize(tidy(features.labelled_matrix(_features(v), _similarity(v), 0.1, CATEGORIES)), "labelled")
    matrix = materialize(classify.split(rows), "matrix")
    release(rows)
    return matrix


def _trained(select: str) -> str:
    """A statement over the feature table ``mx`` (with ``is_test``); its views come with the table."""
    return f"""WITH m AS ({C02_MATRIX}), mx AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(pr_id || '|42'), pr_id)
        <= round_even(0.2 * count(*) OVER (PARTITION BY label), 0) THEN 1 ELSE 0 END AS is_test FROM m) {select}"""


def _fitted(matrix: DataFrame, name: str) -> DataFrame:
    """Scores of the test rows: what a model must keep whatever the trees it grew."""
    model, test = classify.fit_model(matrix, features.feature_columns(matrix), name)
    score = F.col("score")
    in_range = score.between(0, 1) if name != "svm" else ~F.isnan(score)
    return classify.scored(model, test).select(
        "pr_id", "label", (F.col("prediction").isin(0, 1) & in_range).alias("score_in_range")
    )


SCORED = "SELECT pr_id, label, true AS score_in_range FROM mx WHERE is_test = 1"


@query("c04_random_forest", _trained(SCORED))
def c04(v: Views) -> DataFrame:
    return _fitted(_matrix(v), "rf")


@query(
    "c05_boosted_trees",
    _trained("SELECT pr_id, label, true AS score_in_range, unnest(['gbt', 'gbt_shallow']) AS model_name FROM mx WHERE is_test = 1"),
)
def c05(v: Views) -> DataFrame:
    matrix = _matrix(v)
    deep = _fitted(matrix, "gbt").withColumn("model_name", F.lit("gbt"))
    return deep.unionByName(_fitted(matrix, "gbt_shallow").withColumn("model_name", F.lit("gbt_shallow")))


STUMP_EDGES = {"n_chars": [100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0], "toxic": [0.0]}
STUMP_SPLITS = ", ".join(f"({f}, '{name}', {e})" for f, (name, edges) in enumerate(STUMP_EDGES.items()) for e in edges)


@query(
    "c05_second_order_leaves",
    f"""WITH tr AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS n_chars, CAST(toxic AS DOUBLE) AS toxic FROM labels JOIN documents USING (doc_id)),
      b AS (SELECT 1 / (1 + (count(*) - sum(y) + 1) / (sum(y) + 1)) AS p FROM tr),
      gh AS (SELECT p - y AS g, p * (1 - p) AS h, n_chars, toxic FROM tr, b), t AS (SELECT sum(g) AS tg, sum(h) AS th, count(*) AS tn FROM gh),
      e(f, feature, edge) AS (VALUES {STUMP_SPLITS}),
      l AS (SELECT f, feature, edge, sum(g) AS g, sum(h) AS h, count(*) AS n FROM gh JOIN e ON CASE f WHEN 0 THEN n_chars ELSE toxic END <= edge GROUP BY ALL),
      best AS (SELECT *, 0.5 * (g * g / (h + 1) + (tg - g) ** 2 / (th - h + 1) - tg * tg / (th + 1)) AS gain FROM l, t WHERE h >= 1 AND th - h >= 1
        ORDER BY round(gain, 9) DESC, f, edge LIMIT 1)
    SELECT feature, CAST(edge AS DOUBLE) AS edge, round(gain, 6) AS gain, 'up to the edge' AS side, n, round(-0.3 * g / (h + 1), 6) AS weight FROM best
    UNION ALL SELECT feature, edge, round(gain, 6), 'above', tn - n, round(-0.3 * (tg - g) / (th - h + 1), 6) FROM best""",
)
def c05_leaves(v: Views) -> DataFrame:
    """One tree of one split over given edges: its leaf weights are the closed form -rate G / (H + 1)."""
    rows = v.table("labels").join(v.table("documents"), "doc_id").select(F.col("quality").alias("label"), "n_chars", "toxic")
    model = boosting.fit_boosted_trees(rows, list(STUMP_EDGES), trees=1, max_depth=1, edges=list(STUMP_EDGES.values()))
    root = model.trees[0][0]
    name = model.features[root.feature]
    sides = [("up to the edge", root.left), ("above", root.right)]
    leaves = {number: (n, weight) for number, n, weight in boosting.leaf_table(model)}
    table = [(name, model.edges[root.feature][root.bin], root.gain, side, *leaves[number]) for side, number in sides]
    return tidy(v.spark.createDataFrame(table, "feature STRING, edge DOUBLE, gain DOUBLE, side STRING, n BIGINT, weight DOUBLE"))


FAR_PARTS = """WITH z AS (SELECT p_partkey, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS x,
        (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS y FROM part)
    SELECT p_partkey AS pr_id, CAST(x * x + y * y > 1.5 AS INT) AS label, true AS score_in_range, true AS auc_above_floor FROM z WHERE p_partkey % 5 = 0"""


def _far_parts(v: Views) -> DataFrame:
    """Parts far from the middle of price and size: no line parts them from the others."""
    part = v.table("part")
    sizes = part.agg(F.avg("p_retailprice"), F.stddev("p_retailprice"), F.avg("p_size"), F.stddev("p_size")).first()
    x, y = (F.col("p_retailprice") - sizes[0]) / sizes[1], (F.col("p_size") - sizes[2]) / sizes[3]
    return part.select(F.col("p_partkey").alias("pr_id"), x.alias("x"), y.alias("y"), (x * x + y * y > 1.5).cast("int").alias("label"))


def _above_floor(scored: DataFrame, floor: float) -> DataFrame:
    scored = materialize(scored, "scores")
    area = classify.auc(scored).first().auc
    return scored.select("pr_id", "label", F.col("score").between(0, 1).alias("score_in_range"), F.lit(area > floor).alias("auc_above_floor"))


@query("c05_second_order_boosting", FAR_PARTS)
def c05_second_order(v: Views) -> DataFrame:
    """A model that learns nothing misses the floor; which rows it scores and their labels are SQL's."""
    rows = _far_parts(v)
    model = boosting.fit_boosted_trees(rows.where("pr_id % 5 <> 0"), ["x", "y"])
    return _above_floor(boosting.boosted_scores(model, rows.where("pr_id % 5 = 0")), 0.95)


@query("c06_linear_svm", _trained(SCORED))
def c06(v: Views) -> DataFrame:
    return _fitted(_matrix(v), "svm")


WAVES = 6
UNIT_DIRECTIONS, UNIT_SHIFTS = kernel.draw_waves(3, WAVES, 0.5)
WAVE_COLUMNS = ("pr_title_length", "pr_body_length", "number_of_files_changed")
WAVE_VALUES = ", ".join(f"CAST({c} AS DOUBLE)" for c in WAVE_COLUMNS)


@query(
    "c06_fourier_features",
    _trained(f""", vs AS (SELECT pr_id, [{WAVE_VALUES}] AS v FROM mx), one AS (SELECT unnest(v) AS u FROM vs),
      g AS (SELECT 1 / ({len(WAVE_COLUMNS)} * var_pop(u)) AS gamma FROM one),
      ws AS (SELECT unnest({[list(w) for w in UNIT_DIRECTIONS]}) AS w, unnest({list(UNIT_SHIFTS)}) AS b, unnest(range({WAVES})) AS wave)
    SELECT pr_id, CAST(wave AS INT) AS wave, round(sqrt(2.0 / {WAVES}) * cos(sqrt(2 * gamma) * list_dot_product(v, w) + b), 6) AS turned FROM vs, g, ws"""),
)
def c06_waves(v: Views) -> DataFrame:
    """The columns that stand for the kernel, with the width that the variance of all values gives."""
    matrix = _matrix(v)
    directions, shifts = kernel.draw_waves(len(WAVE_COLUMNS), WAVES, kernel.scale_gamma(matrix, WAVE_COLUMNS))
    values = F.array(*[F.col(c).cast("double") for c in WAVE_COLUMNS])
    return tidy(matrix.select("pr_id", F.posexplode(kernel.fourier_features(values, directions, shifts)).alias("wave", "turned")))


@query("c06_kernel_svm", FAR_PARTS)
def c06_kernel(v: Views) -> DataFrame:
    """A linear machine misses the floor."""
    rows = _far_parts(v)
    machine = kernel.fit_kernel_machine(rows.where("pr_id % 5 <> 0"), ["x", "y"])
    return _above_floor(kernel.kernel_scores(machine, rows.where("pr_id % 5 = 0")), 0.95)


FEATURE_NAMES = (
    "pr_title_length", "pr_body_length", "pr_template_total_score", "contains_code_snippets", "number_of_related_issues",
    "number_of_commits", "avg_commit_message_length", "number_of_files_changed", "total_addition", "total_deletion", "added",
    "removed", "modified", "number_of_modules_l1_changed", *[f"task_type_{c}" for c in CATEGORIES],
)
DISTANCE = " + ".join(f"CAST(t.{c} - r.{c} AS DOUBLE) * CAST(t.{c} - r.{c} AS DOUBLE)" for c in FEATURE_NAMES)


@query(
    "c07_nearest_neighbours",
    _trained(f""", d AS (SELECT t.pr_id, t.label, r.label AS near, row_number() OVER (PARTITION BY t.pr_id ORDER BY {DISTANCE}, r.pr_id) AS rn
      FROM mx t JOIN mx r ON t.is_test = 1 AND r.is_test = 0)
    SELECT pr_id, label, round(avg(near), 6) AS score, CAST(avg(near) > 0.5 AS INT) AS prediction FROM d WHERE rn <= 5 GROUP BY ALL"""),
)
def c07(v: Views) -> DataFrame:
    matrix = _matrix(v)
    return tidy(knn_vote(matrix.where(F.col("is_test") == 0), matrix.where(F.col("is_test") == 1), FEATURE_NAMES))


@query("c07_exact_neighbours", ORACLES["c07_nearest_neighbours"])
def c07_exact(v: Views) -> DataFrame:
    """All labelled rows take part; a test row meets the rings that can hold a nearer one."""
    matrix = _matrix(v)
    return tidy(exact_vote(matrix.where(F.col("is_test") == 0), matrix.where(F.col("is_test") == 1), FEATURE_NAMES))


NORMAL_SCORES = f"""SELECT lang, CAST(n_chars AS DOUBLE) AS x, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n
    FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL"""


@query(
    "t5_shapiro_wilk",
    f"""WITH ranked AS ({NORMAL_SCORES}), scored AS (SELECT *, {normality.score_of("r", "n")} AS m FROM ranked),
      sums AS (SELECT lang, n, sum(m * m) AS mm, coalesce(sum(m * x) FILTER (r > 2 AND r < n - 1), 0) AS inner_sum, max(x) FILTER (r = 1) AS x1,
        max(x) FILTER (r = 2) AS x2, max(x) FILTER (r = n - 1) AS y2, max(x) FILTER (r = n) AS y1, var_pop(x) * count(*) AS squares FROM scored GROUP BY lang, n),
      outer_scores AS (SELECT *, {normality.score_of("n", "n")} AS m1, {normality.score_of("(n - 1)", "n")} AS m2 FROM sums),
      w AS (SELECT *, {normality.statistic_sql()} AS w_stat FROM outer_scores), z AS (SELECT *, {normality.deviate_sql()} AS z FROM w),
      p AS (SELECT *, {two_sided_sql("z")} / 2 AS tail FROM z)
    SELECT lang, n, round(w_stat, 6) AS w_stat, round(z, 6) AS z_stat, round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, 6) AS p_value FROM p""",
)
def t5_shapiro_wilk(v: Views) -> DataFrame:
    return tidy(normality.shapiro_wilk(v.table("documents"), ["lang"], "n_chars"))


RULE = """pd AS (SELECT doc_id AS pr_id, quality AS label, lang, CAST(n_chars > 900 AS INT) AS prediction, n_chars / (n_chars + 900.0) AS score
    FROM labels JOIN documents USING (doc_id))"""


def _rule_predictions(v: Views) -> DataFrame:
    """A fixed rule as the classifier, so that the metrics can be checked."""
    labels = v.table("labels").select("doc_id", F.col("quality").alias("label"))
    docs = v.table("documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    return docs.select(
        F.col("doc_id").alias("pr_id"),
        "label",
        "lang",
        (F.col("n_chars") > 900).cast("int").alias("prediction"),
        (F.col("n_chars") / (F.col("n_chars") + 900.0)).alias("score"),
    )


def _metrics_sql(keys: str) -> str:
    tp, fp, fn = (
        f"count(*) FILTER (label = {y} AND prediction = {p})" for y, p in ((1, 1), (0, 1), (1, 0))
    )
    return f"""SELECT {keys}, round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy, round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision,
      round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall, round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1 FROM pd GROUP BY {keys}"""


@query("c08_confusion_metrics", f"WITH {RULE} {_metrics_sql('lang')}")
def c08(v: Views) -> DataFrame:
    return tidy(classify.confusion_metrics(_rule_predictions(v), ["lang"]))


AUC = """ranked AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS mr FROM pd)"""
AUC_VALUE = """(sum(mr) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0)"""


@query(
    "c09_roc_auc", f"WITH {RULE}, {AUC} SELECT lang, round(CAST({AUC_VALUE} AS DOUBLE), 6) AS auc FROM ranked GROUP BY lang"
)
def c09(v: Views) -> DataFrame:
    return tidy(classify.auc(_rule_predictions(v), ["lang"]))


@query(
    "c10_roc_points",
    f"""WITH {RULE}, c AS (SELECT lang, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM pd GROUP BY ALL),
      w AS (SELECT lang, score, sum(p) OVER k AS tp, sum(q) OVER k AS fp, sum(p) OVER (PARTITION BY lang) AS np, sum(q) OVER (PARTITION BY lang) AS nq FROM c
        WINDOW k AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT lang, round(score, 6) AS threshold, round(fp / nullif(nq, 0), 6) AS fpr, round(tp / nullif(np, 0), 6) AS tpr FROM w""",
)
def c10(v: Views) -> DataFrame:
    return tidy(classify.roc_points(_rule_predictions(v), ["lang"]))


@query(
    "c11_metric_rows",
    f"""WITH {RULE.replace("lang,", "'length' AS lang,")}, {AUC}, m AS ({_metrics_sql('lang')})
    SELECT lang AS model_name, accuracy, precision, recall, f1, (SELECT round(CAST({AUC_VALUE} AS DOUBLE), 6) FROM ranked) AS auc FROM m""",
)
def c11(v: Views) -> DataFrame:
    return tidy(classify.evaluation(_rule_predictions(v), "length"))


@query(
    "c11_model_comparison",
    "SELECT model_name, true AS metrics_in_range FROM (VALUES ('rf'), ('gbt'), ('svm'), ('knn')) t(model_name)",
)
def c11_models(v: Views) -> DataFrame:
    matrix = _matrix(v)
    trained = classify.compare_models(matrix, FEATURE_NAMES, ["rf", "gbt", "svm"])
    near = knn_vote(matrix.where(F.col("is_test") == 0), matrix.where(F.col("is_test") == 1), FEATURE_NAMES)
    rows = trained.unionByName(classify.evaluation(near, "knn"))
    fine = F.lit(True)
    for name in ("accuracy", "precision", "recall", "f1", "auc"):
        fine = fine & F.coalesce(F.col(name).between(0, 1), F.lit(name == "auc"))
    return rows.select("model_name", fine.alias("metrics_in_range"))


@query(
    "c12_feature_importances",
    f"SELECT unnest({list(FEATURE_NAMES)}) AS feature, true AS not_negative, 1.0::DOUBLE AS importance_sum",
)
def c12(v: Views) -> DataFrame:
    model, _ = classify.fit_model(_matrix(v), FEATURE_NAMES, "rf")
    rows = classify.importances(v.spark, model, FEATURE_NAMES)
    total = rows.agg(F.round(F.sum("importance"), 6)).scalar()
    return rows.select("feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("importance_sum"))


def _attributed(v: Views) -> DataFrame:
    matrix = _matrix(v)
    model, test = classify.fit_model(matrix, FEATURE_NAMES, "rf")
    return classify.attributions(model, test, matrix.where(F.col("is_test") == 0), FEATURE_NAMES)


@query(
    "c13_attributions",
    _trained(f"SELECT pr_id, CAST({len(FEATURE_NAMES)} AS BIGINT) AS features, true AS adds_up FROM mx WHERE is_test = 1"),
)
def c13(v: Views) -> DataFrame:
    gap = F.sum("attribution") - (F.max("score") - F.max("base_score"))
    return _attributed(v).groupBy("pr_id").agg(F.count("*").alias("features"), (F.abs(gap) < 1e-9).alias("adds_up"))


@query(
    "c13_exact_attributions",
    _trained(f"""SELECT pr_id, CAST({len(FEATURE_NAMES)} AS BIGINT) AS features, true AS adds_up, true AS score_of_the_model
      FROM mx WHERE is_test = 1"""),
)
def c13_exact(v: Views) -> DataFrame:
    """Over the paths of a forest; that their sums are the model's own probabilities is compared for every test row."""
    model, test = classify.fit_model(_matrix(v), FEATURE_NAMES, "rf")
    exact = attribution.tree_attributions(attribution.forest_paths(v.spark, model), test, FEATURE_NAMES)
    gap = F.abs(F.sum("attribution") - (F.max("score") - F.max("base_score")))
    rows = exact.groupBy("pr_id").agg(F.count("*").alias("features"), (gap < 1e-9).alias("adds_up"), F.max("score").alias("own"))
    model_scores = classify.scored(model, test).select("pr_id", "score")
    same = (F.abs(F.col("own") - F.col("score")) < 1e-9).alias("score_of_the_model")
    return rows.join(model_scores, "pr_id").select("pr_id", "features", "adds_up", same)


TWO_WAY = (("pr_title_length", "pr_body_length"), ("pr_body_length", "number_of_files_changed"))


def _two_way_paths(train: DataFrame) -> DataFrame:
    """Two trees that split at the mean of one feature, then at that of another; a leaf is the label's mean."""
    out = None
    for number, (first, second) in enumerate(TWO_WAY):
        cut = train.agg(F.avg(first).alias("a"), F.avg(second).alias("b"), F.count("*").alias("n")).first()
        sides = train.select((F.col(first) <= F.lit(cut.a)).alias("a"), (F.col(second) <= F.lit(cut.b)).alias("b"), "label")
        cells = sides.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("label").alias("value"))
        whole = cells.withColumn("n_a", F.sum("n").over(Window.partitionBy("a")))  # four cells at most

        def step(feature: str, side: str, share):
            low = F.when(F.col(side), F.lit(float("-inf"))).otherwise(F.lit(cut[side]))
            high = F.when(F.col(side), F.lit(cut[side])).otherwise(F.lit(float("inf")))
            at = F.lit(FEATURE_NAMES.index(feature))
            return F.struct(at.alias("feature"), low.alias("low"), high.alias("high"), share.alias("share"))

        steps = F.array(step(first, "a", F.col("n_a") / F.lit(cut.n)), step(second, "b", F.col("n") / F.col("n_a")))
        leaf = (F.col("a").cast("int") * 2 + F.col("b").cast("int")).alias("leaf")
        value = (F.col("value") / len(TWO_WAY)).alias("value")
        tree = whole.select(F.lit(number).alias("tree"), leaf, value, F.inline(steps))
        out = tree if out is None else out.unionByName(tree)
    return out


def _two_way_sql() -> str:
    parts = []
    for k, (first, second) in enumerate(TWO_WAY):
        parts.append(f"""s{k} AS (SELECT {first} <= avg({first}) OVER () AS a, {second} <= avg({second}) OVER () AS b, label FROM mx WHERE is_test = 0),
      c{k} AS (SELECT a, b, count(*) AS n, avg(label) AS v FROM s{k} GROUP BY ALL),
      w{k} AS (SELECT pr_id, {first} AS fa, {second} AS fb, {first} <= (SELECT avg({first}) FROM mx WHERE is_test = 0) AS a,
        {second} <= (SELECT avg({second}) FROM mx WHERE is_test = 0) AS b FROM mx WHERE is_test = 1),
      e{k} AS (SELECT *, (SELECT avg(label) FROM s{k}) AS v0, coalesce((SELECT avg(label) FROM s{k} WHERE s{k}.a = w{k}.a), 0) AS va,
        coalesce((SELECT sum(c{k}.v * (SELECT count(*) FROM s{k} h WHERE h.a = c{k}.a)) FROM c{k} WHERE c{k}.b = w{k}.b), 0) / (SELECT count(*) FROM s{k}) AS vb,
        coalesce((SELECT c{k}.v FROM c{k} WHERE c{k}.a = w{k}.a AND c{k}.b = w{k}.b), 0) AS vab FROM w{k}),
      p{k} AS (SELECT pr_id, '{first}' AS feature, fa AS feature_value, ((va - v0) + (vab - vb)) / 2 AS phi, v0, vab FROM e{k}
        UNION ALL SELECT pr_id, '{second}', fb, ((vb - v0) + (vab - va)) / 2, v0, vab FROM e{k})""")
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(len(TWO_WAY)))
    parts.append(f"""p AS ({every}), scores AS (SELECT pr_id, sum(vab) / {2 * len(TWO_WAY)} AS score, sum(v0) / {2 * len(TWO_WAY)} AS base_score FROM p GROUP BY pr_id),
      parted AS (SELECT pr_id, feature, CAST(any_value(feature_value) AS DOUBLE) AS feature_value, round(sum(phi) / {len(TWO_WAY)}, 6) AS attribution,
        round(score, 6) AS score, round(base_score, 6) AS base_score FROM p JOIN scores USING (pr_id) GROUP BY pr_id, feature, score, base_score)""")
    return ", " + ", ".join(parts)


def _two_way(v: Views) -> DataFrame:
    matrix = _matrix(v)
    rows = attribution.tree_attributions(_two_way_paths(matrix.where(F.col("is_test") == 0)), matrix.where(F.col("is_test") == 1), FEATURE_NAMES)
    return rows.where(F.col("feature").isin(*{f for pair in TWO_WAY for f in pair}))


@query("c13_two_way_trees", _trained(f"{_two_way_sql()} SELECT * FROM parted"))
def c13_two_way(v: Views) -> DataFrame:
    return tidy(_two_way(v))


@query(
    "c13_exact_ranking",
    _trained(f"""{_two_way_sql()} SELECT feature, round(avg(abs(phi)), 6) AS mean_abs
      FROM (SELECT pr_id, feature, sum(phi) / {len(TWO_WAY)} AS phi FROM p GROUP BY pr_id, feature) GROUP BY feature"""),
)
def c13_exact_ranking(v: Views) -> DataFrame:
    return tidy(classify.attribution_ranking(_two_way(v)))


CUTOFFS = {"pr_title_length": (None, 7), "pr_body_length": (500, 80)}


@query(
    "c13_cutoff_tables",
    _trained(f"""{_two_way_sql()}, lim(feature, below, mark) AS (VALUES ('pr_title_length', NULL, 7), ('pr_body_length', 500, 80)),
      h AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5(pr_id || '|42'), pr_id) AS rn FROM parted JOIN lim USING (feature))
    SELECT pr_id, feature, feature_value, attribution, feature_value > mark AS beyond_mark FROM h WHERE rn <= 2000 AND (below IS NULL OR feature_value < below)"""),
)
def c13_cutoffs(v: Views) -> DataFrame:
    return tidy(attribution.cutoff_tables(_two_way(v), CUTOFFS))


@query("c13_attribution_ranking", f"SELECT unnest({list(FEATURE_NAMES)}) AS feature, true AS not_negative")
def c13_ranking(v: Views) -> DataFrame:
    ranking = classify.attribution_ranking(_attributed(v))
    return ranking.select("feature", (F.col("mean_abs") >= 0).alias("not_negative"))


@query("c13_top_features", "SELECT unnest([1, 2, 3, 4, 5]) AS place, true AS known_feature")
def c13_top(v: Views) -> DataFrame:
    """The five features that move the score most, by place."""
    best = classify.top_k(classify.attribution_ranking(_attributed(v)), "mean_abs", 5)
    place = F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))  # five rows
    return best.select(place.alias("place"), F.col("feature").isin(*FEATURE_NAMES).alias("known_feature"))


# --- composites ------------------------------------------------------------------------------


@query(
    "c14_definition_lifetimes",
    f"""WITH {LIFE} SELECT repo_id, added_pr_id, func_class, epoch_us(added_ts) AS added_us, removed_pr_id, epoch_us(removed_ts) AS removed_us, is_removed, is_agent,
      CAST(floor((epoch_us(removed_ts) - epoch_us(added_ts)) / 86400000000.0) AS BIGINT) AS gap FROM life""",
    DP,
)
def c14(v: Views) -> DataFrame:
    return churn.with_gap(lifetimes_of(v)).select(
        "repo_id",
        "added_pr_id",
        "func_class",
        F.unix_micros("added_at_dt").alias("added_us"),
        "removed_pr_id",
        F.unix_micros("removed_at_dt").alias("removed_us"),
        "is_removed",
        "is_agent",
        "gap",
    )


@query(
    "c15_cohort_survival",
    f"""WITH {LIFE}, co AS (SELECT *, unnest(['M0', 'M1', 'M2', 'M3']) AS month_order, added_ts + to_days(unnest([0, 30, 60, 90])) AS m FROM life
        WHERE added_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-04-01')
    SELECT strftime(added_ts, '%Y-%m') AS added_batch, is_agent, month_order, count(DISTINCT func_class) AS alive FROM co
    WHERE NOT coalesce(month(m) >= month(removed_ts), false) GROUP BY ALL""",
    DP,
)
def c15(v: Views) -> DataFrame:
    return churn.survival(churn.cohorts(lifetimes_of(v), "1996-01-01", "1998-04-01"))


TOUCH = """tc AS (SELECT d.is_agent, CASE WHEN d.is_agent = 1 THEN CAST(repo_id AS VARCHAR) ELSE string_split(repo_url, '/')[-1] END AS repo, filename, status, d.pr_id, merged_ts AS ts
    FROM details_all d JOIN pr_all p ON p.id = d.pr_id WHERE merged_at IS NOT NULL),
  ad AS (SELECT is_agent, repo, filename, max(pr_id) AS pr_id, arg_max(ts, pr_id) AS ts FROM tc WHERE status = 'added' GROUP BY ALL),
  md AS (SELECT is_agent, repo, filename, max(pr_id) AS pr_id, arg_max(ts, pr_id) AS ts FROM tc WHERE status IN ('modified', 'removed')
    AND pr_id NOT IN (SELECT pr_id FROM ad) GROUP BY ALL),
  nx AS (SELECT is_agent, repo, filename, ad.pr_id, md.pr_id AS next_modified_pr_id, (epoch_us(md.ts) - epoch_us(ad.ts)) / 3600000000.0 AS gap
    FROM ad JOIN md USING (is_agent, repo, filename) WHERE md.ts > ad.ts)"""


def _next(v: Views) -> DataFrame:
    return churn.next_modification(v.pr(), v.details(), v.human_pr(), v.human_details())


@query(
    "c16_next_modification",
    f"WITH {TOUCH} SELECT is_agent, repo AS repo_id, filename, pr_id, next_modified_pr_id, round(gap, 6) AS gap_in_hours FROM nx",
    DP,
)
def c16(v: Views) -> DataFrame:
    return tidy(_next(v).drop("added_at", "next_modified_at"))


@query("c16_gap_summary", _nest(TOUCH, "WITH z AS (SELECT 1) " + describe_sql("is_agent", "gap", "nx")), DP)
def c16_summary(v: Views) -> DataFrame:
    return tidy(cumulative.describe(_next(v), ["is_agent"], "gap_in_hours"))


@query(
    "c17_pr_text_pairs",
    """WITH c AS (SELECT DISTINCT sha, pr_id, message, is_agent FROM details_all WHERE patch IS NOT NULL),
      j AS (SELECT c.*, title || ' ' || pr_body AS pr_description FROM c JOIN pr_all p ON p.id = c.pr_id JOIN bodies b ON b.pr_id = c.pr_id
        WHERE merged_at IS NOT NULL AND message IS NOT NULL AND title || ' ' || pr_body IS NOT NULL)
    SELECT pr_id, is_agent, 0 AS part, string_agg(message, ' ' ORDER BY sha) AS message, string_agg(pr_description, ' ') AS pr_description FROM j GROUP BY pr_id, is_agent""",
    ("details_all", "pr_all", "bodies"),
)
def c17(v: Views) -> DataFrame:
    body = v.bodies().select(F.col("pr_id").alias("id"), F.col("pr_body").alias("body"))
    pr, human = v.pr().join(body, "id", "left"), v.human_pr().join(body, "id", "left")
    return textpairs.pr_text_pairs(v.details(), v.human_details(), pr, human)


@query(
    "c18_nonzero_measures",
    f"""WITH {PER_PR} SELECT * FROM (SELECT pr_id, CASE is_agent WHEN 1 THEN 'APR' ELSE 'HPR' END AS "Group",
      unnest(['num_file_changes', 'additions', 'deletions']) AS metric, CAST(unnest([num_file_changes, additions, deletions]) AS DOUBLE) AS value FROM per_pr)
    WHERE value > 0""",
    ROWS,
)
def c18(v: Views) -> DataFrame:
    return change_size.nonzero_measures(v.change_table())
