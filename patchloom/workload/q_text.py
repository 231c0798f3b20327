"""Scalar functions (F), patch operators (D), predictors (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import patches, paths, text, times, vectors
from patchloom.operators import predictors
from patchloom.plans import features, language, textpairs
from patchloom.workload.common import tidy
from patchloom.workload.q_relational import COS, HEADING, ISSUE, OVERLAP, W
from patchloom.workload.registry import query
from patchloom.workload.views import Views

D, P, B = ("details_all",), ("pr_all",), ("bodies",)

PROMPT = "Commit message:\n{message}\n\nDiff:\n{patch}\n\nScore what and why from 0 to 5."


# --- scalar functions ---------------------------------------------------------------------


@query(
    "f01_modules",
    """SELECT DISTINCT filename, CASE WHEN len(string_split(filename, '/')) >= 2 THEN string_split(filename, '/')[-2] END AS module_l1,
      CASE WHEN len(string_split(filename, '/')) >= 3 THEN string_split(filename, '/')[-3] END AS module_l2 FROM details_all""",
    D,
)
def f01(v: Views) -> DataFrame:
    name = F.col("filename")
    rows = v.all_details().select("filename").distinct()
    return rows.select("filename", paths.module_l1(name).alias("module_l1"), paths.module_l2(name).alias("module_l2"))


@query(
    "f02_repo_full_name",
    "SELECT id, string_split(repo_url, '/')[-2] || '/' || string_split(repo_url, '/')[-1] AS repo FROM pr_all",
    P,
)
def f02(v: Views) -> DataFrame:
    return v.all_prs().select("id", paths.repo_full_name(F.col("repo_url")).alias("repo"))


@query("f03_repo_short_name", "SELECT id, string_split(repo_url, '/')[-1] AS repo FROM pr_all", P)
def f03(v: Views) -> DataFrame:
    return v.all_prs().select("id", paths.repo_short_name(F.col("repo_url")).alias("repo"))


@query(
    "f04_word_counts",
    r"""SELECT pr_id, len(regexp_extract_all(pr_title, '\S+')) AS pr_title_length, len(regexp_extract_all(pr_body, '\S+')) AS pr_body_length
    FROM bodies""",
    B,
)
def f04(v: Views) -> DataFrame:
    counted = features.body_words(features.title_words(v.bodies()))
    return counted.select("pr_id", "pr_title_length", "pr_body_length")


@query(
    "f05_words_per_commit",
    r"""SELECT pr_id, count(sha) AS number_of_commits, round(sum(len(regexp_extract_all(message, '\S+'))) / count(sha), 6) AS avg_commit_message_length
    FROM commits GROUP BY pr_id""",
    ("commits",),
)
def f05(v: Views) -> DataFrame:
    return tidy(features.commit_counts(v.commits()))


@query("f06_char_length", "SELECT pr_id, length(pr_body) AS body_len FROM bodies", B)
def f06(v: Views) -> DataFrame:
    return v.bodies().select("pr_id", text.char_count(F.col("pr_body")).cast("bigint").alias("body_len"))


@query("f07_description", "SELECT pr_id, pr_title || ' ' || pr_body AS pr_description FROM bodies", B)
def f07(v: Views) -> DataFrame:
    return v.bodies().select("pr_id", text.description(F.col("pr_title"), F.col("pr_body")).alias("pr_description"))


EXT = r"regexp_extract(lower(filename), '(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$', 1)"
LANG = f"""CASE {EXT} WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' WHEN '.pyw' THEN 'python' WHEN '.ts' THEN 'typescript'
  WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' END"""


@query("f08_language", f"SELECT DISTINCT filename, {EXT} AS ext, {LANG} AS lang FROM details_all", D)
def f08(v: Views) -> DataFrame:
    rows = v.all_details().select("filename").distinct()
    name = F.col("filename")
    return rows.select("filename", paths.extension(name).alias("ext"), paths.language_of(name).alias("lang"))


@query(
    "f09_issue_links",
    f"""SELECT pr_id, coalesce(regexp_matches(pr_body, '{ISSUE}'), false) AS linked,
      array_to_string(regexp_extract_all(pr_body, '{ISSUE}'), '; ') AS links FROM bodies""",
    B,
)
def f09(v: Views) -> DataFrame:
    body = F.col("pr_body")
    return v.bodies().select(
        "pr_id", text.has_issue_link(body).alias("linked"), F.array_join(text.issue_links(body), "; ").alias("links")
    )


@query(
    "f10_headings",
    f"""WITH h AS (SELECT pr_id, list_sort(list_distinct(regexp_extract_all(pr_body, '{HEADING}', 1))) AS hs FROM bodies)
    SELECT pr_id, coalesce(array_to_string(hs, ';'), '') AS headings, round(coalesce(len(hs), 0) / (SELECT greatest(max(len(hs)), 1) FROM h), 6)
      AS common_template_heading_score FROM h""",
    B,
)
def f10(v: Views) -> DataFrame:
    scored = features.heading_score(v.bodies())
    names = F.array_join(F.array_sort(text.template_headings(F.col("pr_body"))), ";")
    return tidy(scored.select("pr_id", names.alias("headings"), "common_template_heading_score"))


@query(
    "f11_checklists",
    r"""SELECT pr_id, pr_body IS NOT NULL AS flag, coalesce(regexp_matches(pr_body, '(?m)^[\s*]*[-*]?\s*\[[xX\s]\]'), false) AS fixed_flag FROM bodies""",
    B,
)
def f11(v: Views) -> DataFrame:
    body = F.col("pr_body")
    return v.bodies().select(
        "pr_id", text.has_checklist(body).alias("flag"), text.has_checklist(body, fixed=True).alias("fixed_flag")
    )


FENCE = r"regexp_extract_all(pr_body, '(?s)```\w*\s*(.*?)```', 1)"


@query(
    "f12_code_snippets",
    f"""SELECT pr_id, coalesce(array_to_string(list_transform({FENCE}, lambda x: trim(x, ' ' || chr(10))), '|'), '') AS code FROM bodies""",
    B,
)
def f12(v: Views) -> DataFrame:
    return v.bodies().select("pr_id", F.array_join(text.code_snippets(F.col("pr_body")), "|").alias("code"))


@query(
    "f13_code_flag_and_ratio",
    rf"""SELECT pr_id, coalesce(len({FENCE}), 0) > 0 AS contains_code_snippets,
      round(coalesce(len({FENCE}), 0) / nullif(len(regexp_extract_all(pr_body, '\S+')), 0), 6) AS ratio FROM bodies""",
    B,
)
def f13(v: Views) -> DataFrame:
    body = F.col("pr_body")
    ratio = text.code_ratio(body, text.word_count(body))
    return tidy(v.bodies().select("pr_id", text.has_code(body).alias("contains_code_snippets"), ratio.alias("ratio")))


CREATED = "strptime(created_at, '%Y-%m-%dT%H:%M:%SZ')"
MERGED = "strptime(merged_at, '%Y-%m-%dT%H:%M:%SZ')"


@query("f14_month_bucket", f"SELECT id, strftime({CREATED}, '%Y-%m') AS ym FROM pr_all", P)
def f14(v: Views) -> DataFrame:
    return v.all_prs().select("id", times.year_month(times.parse_iso(F.col("created_at"))).alias("ym"))


@query("f15_iso_to_timestamp", f"SELECT id, epoch_us({MERGED}) AS micros FROM pr_all", P)
def f15(v: Views) -> DataFrame:
    return v.all_prs().select("id", F.unix_micros(times.parse_iso(F.col("merged_at"))).alias("micros"))


GAP = f"(epoch_us({MERGED}) - epoch_us({CREATED}))"


@query(
    "f16_whole_day_gap",
    f"SELECT id, CAST(floor({GAP} / 86400000000.0) AS BIGINT) AS gap, CAST(floor(-{GAP} / 86400000000.0) AS BIGINT) AS back FROM pr_all",
    P,
)
def f16(v: Views) -> DataFrame:
    a, b = times.parse_iso(F.col("created_at")), times.parse_iso(F.col("merged_at"))
    return v.all_prs().select("id", times.gap_days(a, b).alias("gap"), times.gap_days(b, a).alias("back"))


@query("f17_hours_gap", f"SELECT id, round({GAP} / 3600000000.0, 6) AS hours FROM pr_all", P)
def f17(v: Views) -> DataFrame:
    a, b = times.parse_iso(F.col("created_at")), times.parse_iso(F.col("merged_at"))
    return tidy(v.all_prs().select("id", times.gap_hours(a, b).alias("hours")))


@query(
    "f18_plus_days",
    f"SELECT id, strftime({CREATED} + to_days(30), '%Y-%m-%d') AS m1, strftime({CREATED} + to_days(90), '%Y-%m-%d') AS m3 FROM pr_all",
    P,
)
def f18(v: Views) -> DataFrame:
    ts = times.parse_iso(F.col("created_at"))
    return v.all_prs().select(
        "id",
        F.date_format(times.plus_days(ts, 30), "yyyy-MM-dd").alias("m1"),
        F.date_format(times.plus_days(ts, 90), "yyyy-MM-dd").alias("m3"),
    )


@query("f19_month_number", f"SELECT id, CAST(month({CREATED}) AS INTEGER) AS m FROM pr_all", P)
def f19(v: Views) -> DataFrame:
    return v.all_prs().select("id", F.month(times.parse_iso(F.col("created_at"))).alias("m"))


@query("f20_cosine", f"SELECT pr_id, round({COS}, 6) AS similarity FROM vec_pairs", ("vec_pairs",))
def f20(v: Views) -> DataFrame:
    pairs = v.embedding_pairs()
    return tidy(
        pairs.select("pr_id", vectors.cosine(F.col("left_embedding"), F.col("right_embedding")).alias("similarity"))
    )


@query(
    "f21_mean_abs_per_dimension",
    """SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(abs(CAST(x AS DOUBLE))), 6) AS mean_abs FROM
      (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i""",
)
def f21(v: Views) -> DataFrame:
    cells = v.table("embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    return tidy(cells.groupBy("dim").agg(vectors.mean_abs(F.col("x").cast("double")).alias("mean_abs")))


@query(
    "f22_row_arithmetic",
    "SELECT pr_id, sha, filename, additions + deletions AS total, round(additions / nullif(changes, 0), 6) AS added_share FROM details_all",
    D,
)
def f22(v: Views) -> DataFrame:
    share = F.try_divide(F.col("additions").cast("double"), "changes")
    return tidy(
        v.all_details().select(
            "pr_id", "sha", "filename", (F.col("additions") + F.col("deletions")).alias("total"), share.alias("added_share")
        )
    )


@query(
    "f23_prompts",
    """SELECT sha, 'Commit message:' || chr(10) || coalesce(message, '') || chr(10) || chr(10) || 'Diff:' || chr(10) || coalesce(patch, '')
      || chr(10) || chr(10) || 'Score what and why from 0 to 5.' AS prompt FROM details_all""",
    D,
)
def f23(v: Views) -> DataFrame:
    prompt = text.render(PROMPT, message=F.col("message"), patch=F.col("patch"))
    return v.all_details().select("sha", prompt.alias("prompt"))


@query("f24_blank_test", "SELECT pr_id, coalesce(trim(pr_body, ' ' || chr(10)) <> '', false) AS filled FROM bodies", B)
def f24(v: Views) -> DataFrame:
    return v.bodies().select("pr_id", text.has_text(F.col("pr_body")).alias("filled"))


def _names_sql(sign: str, kind: str) -> str:
    """List of names of one sign and kind of a patch with language ``lang``."""

    def split_at(start: int, *stops: str) -> str:
        out = f"x[{start}:]"
        for stop in stops:
            out = f"string_split({out}, '{stop}')[1]"
        return f"trim({out})"

    s = sign
    if kind == "functions":
        cases = f"""WHEN lang = 'python' AND starts_with(x, '{s}def ') THEN {split_at(6, '(')}
          WHEN lang = 'typescript' AND starts_with(x, '{s}function ') THEN {split_at(11, '(')}
          WHEN lang = 'typescript' AND starts_with(x, '{s}const ') AND contains(x, '=>') THEN {split_at(8, '=')}
          WHEN lang = 'typescript' AND starts_with(x, '{s}let ') AND contains(x, '=>') THEN {split_at(6, '=')}
          WHEN lang = 'go' AND starts_with(x, '{s}func ') THEN {split_at(7, '(')}"""
    else:
        cases = f"""WHEN lang = 'python' AND starts_with(x, '{s}class ') THEN {split_at(8, '(', ':')}
          WHEN lang = 'typescript' AND starts_with(x, '{s}class ') THEN {split_at(8, '{')}"""
    names = f"list_transform(string_split(patch, chr(10)), lambda x: CASE {cases} ELSE '' END)"
    return f"coalesce(array_to_string(list_sort(list_filter(list_distinct({names}), lambda n: n <> '')), ';'), '')"


def _sorted_names(df: DataFrame, columns) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[F.array_join(F.array_sort(F.col(c)), ";").alias(c) for c in columns],
    )


FILES = f"files AS (SELECT filename, patch, {LANG} AS lang FROM details_all)"


def _files(v: Views) -> DataFrame:
    rows = v.all_details().select("filename", "patch")
    return rows.withColumn("lang", paths.language_of(F.col("filename")))


@query(
    "f25_combined_names",
    f"""WITH {FILES} SELECT filename, patch, concat_ws(';', nullif({_names_sql('+', 'functions')}, ''), nullif({_names_sql('+', 'classes')}, '')) AS names
    FROM files""",
    D,
)
def f25(v: Views) -> DataFrame:
    names = patches.combined_names(
        patches.function_names(F.col("patch"), F.col("lang"), "+"), patches.class_names(F.col("patch"), F.col("lang"), "+")
    )
    return _files(v).select("filename", "patch", F.array_join(names, ";").alias("names"))


# --- patch text ---------------------------------------------------------------------------


@query(
    "d01_patch_lines",
    "SELECT patch, array_to_string(string_split(patch, chr(10)), '|') AS lines FROM details_all WHERE patch IS NOT NULL",
    D,
)
def d01(v: Views) -> DataFrame:
    rows = v.all_details().where(F.col("patch").isNotNull()).select("patch")
    return rows.select("patch", F.array_join(patches.patch_lines(F.col("patch")), "|").alias("lines"))


@query(
    "d02_added_code",
    """WITH a AS (SELECT patch, list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')),
        lambda x: x[2:]) AS code FROM details_all WHERE patch IS NOT NULL),
      m AS (SELECT *, coalesce(list_min(list_transform(list_filter(code, lambda x: trim(x) <> ''), lambda x: length(x) - length(ltrim(x)))), 0) AS margin FROM a)
    SELECT patch, array_to_string(list_transform(code, lambda x: x[margin + 1:]), chr(10)) AS code FROM m""",
    D,
)
def d02(v: Views) -> DataFrame:
    rows = v.all_details().where(F.col("patch").isNotNull()).select("patch")
    return rows.select("patch", patches.added_code(F.col("patch")).alias("code"))


@query(
    "d03_old_and_new_code",
    """WITH l AS (SELECT patch, list_filter(string_split(patch, chr(10)), lambda x: NOT (starts_with(x, '---') OR starts_with(x, '+++') OR starts_with(x, '@@'))) AS k
        FROM details_all)
    SELECT patch, array_to_string(list_transform(list_filter(k, lambda x: NOT starts_with(x, '+')), lambda x: CASE WHEN left(x, 1) IN ('-', ' ') THEN x[2:] ELSE x END), chr(10)) AS old_code,
      array_to_string(list_transform(list_filter(k, lambda x: NOT starts_with(x, '-')), lambda x: CASE WHEN left(x, 1) IN ('+', ' ') THEN x[2:] ELSE x END), chr(10)) AS new_code FROM l""",
    D,
)
def d03(v: Views) -> DataFrame:
    rows = v.all_details().select("patch")
    return rows.select(
        "patch", patches.old_code(F.col("patch")).alias("old_code"), patches.new_code(F.col("patch")).alias("new_code")
    )


@query(
    "d04_function_names",
    f"WITH {FILES} SELECT filename, patch, {_names_sql('+', 'functions')} AS added, {_names_sql('-', 'functions')} AS removed FROM files",
    D,
)
def d04(v: Views) -> DataFrame:
    rows = _files(v).select(
        "filename",
        "patch",
        patches.function_names(F.col("patch"), F.col("lang"), "+").alias("added"),
        patches.function_names(F.col("patch"), F.col("lang"), "-").alias("removed"),
    )
    return _sorted_names(rows, ["added", "removed"])


@query(
    "d05_class_names",
    f"WITH {FILES} SELECT filename, patch, {_names_sql('+', 'classes')} AS added, {_names_sql('-', 'classes')} AS removed FROM files",
    D,
)
def d05(v: Views) -> DataFrame:
    rows = _files(v).select(
        "filename",
        "patch",
        patches.class_names(F.col("patch"), F.col("lang"), "+").alias("added"),
        patches.class_names(F.col("patch"), F.col("lang"), "-").alias("removed"),
    )
    return _sorted_names(rows, ["added", "removed"])


FOUR = ", ".join(
    f"{_names_sql(s, k)} AS {n}_{k}" for s, n in (("+", "added"), ("-", "removed")) for k in ("functions", "classes")
)


@query(
    "d06_change_record",
    f"WITH {FILES} SELECT filename, patch, {FOUR} FROM files WHERE patch IS NOT NULL AND lang IS NOT NULL",
    D,
)
def d06(v: Views) -> DataFrame:
    rows = _files(v).where(F.col("patch").isNotNull() & F.col("lang").isNotNull())
    four = rows.select("filename", "patch", *patches.change_columns(F.col("patch"), F.col("lang")))
    return _sorted_names(four, patches.CHANGE_COLUMNS)


@query("d07_null_safe_record", f"WITH {FILES} SELECT filename, patch, {FOUR} FROM files", D)
def d07(v: Views) -> DataFrame:
    rows = v.all_details().select("filename", "patch")
    four = rows.select("filename", "patch", *patches.changes_of_file(F.col("patch"), F.col("filename")))
    return _sorted_names(four, patches.CHANGE_COLUMNS)


@query(
    "d08_checked_record",
    f"""WITH {FILES} SELECT filename, patch, lang AS language, CASE WHEN lang IS NULL THEN 'Language not supported: ' || filename END AS error, {FOUR}
    FROM files""",
    D,
)
def d08(v: Views) -> DataFrame:
    rows = v.all_details().select("filename", "patch")
    checked = rows.select("filename", "patch", *patches.checked_changes(F.col("patch"), F.col("filename")))
    return _sorted_names(checked, patches.CHANGE_COLUMNS)


def _simple_sql(sign: str, word: str, stop: str) -> str:
    name = f"trim(string_split(trim(string_split(x, '{word}')[2]), '{stop}')[1])"
    names = f"list_transform(list_filter(string_split(patch, chr(10)), lambda x: starts_with(x, '{sign}{word}')), lambda x: {name})"
    return f"coalesce(array_to_string(list_filter({names}, lambda n: n <> ''), ';'), '')"


@query(
    "d09_simple_python_names",
    f"""SELECT patch, {_simple_sql('+', 'def', '(')} AS added_functions, {_simple_sql('-', 'def', '(')} AS removed_functions,
      {_simple_sql('+', 'class', ':')} AS added_classes, {_simple_sql('-', 'class', ':')} AS removed_classes
    FROM details_all WHERE patch IS NOT NULL""",
    D,
)
def d09(v: Views) -> DataFrame:
    patch = F.col("patch")
    rows = v.all_details().where(patch.isNotNull()).select("patch")
    return rows.select(
        "patch",
        F.array_join(patches.simple_functions(patch, "+"), ";").alias("added_functions"),
        F.array_join(patches.simple_functions(patch, "-"), ";").alias("removed_functions"),
        F.array_join(patches.simple_classes(patch, "+"), ";").alias("added_classes"),
        F.array_join(patches.simple_classes(patch, "-"), ";").alias("removed_classes"),
    )


CODE = """code AS (SELECT filename, patch, lang,
    array_to_string(list_transform(list_filter(k, lambda x: NOT starts_with(x, '+')), lambda x: CASE WHEN left(x, 1) IN ('-', ' ') THEN x[2:] ELSE x END), chr(10)) AS o,
    array_to_string(list_transform(list_filter(k, lambda x: NOT starts_with(x, '-')), lambda x: CASE WHEN left(x, 1) IN ('+', ' ') THEN x[2:] ELSE x END), chr(10)) AS n
  FROM (SELECT *, list_filter(string_split(patch, chr(10)), lambda x: NOT (starts_with(x, '---') OR starts_with(x, '+++') OR starts_with(x, '@@'))) AS k FROM files
    WHERE lang IS NOT NULL AND patch IS NOT NULL))"""


def _scan(col: str, kind: str) -> str:
    if kind == "functions":
        return (
            f"CASE lang WHEN 'python' THEN regexp_extract_all({col}, '(?m)^[ \\t]*def[ \\t]+(\\w+)', 1) "
            f"WHEN 'go' THEN regexp_extract_all({col}, '(?m)^func[ \\t]+(\\w+)', 1) "
            f"ELSE regexp_extract_all({col}, '(?m)^[ \\t]*function[ \\t]+(\\w+)', 1) END"
        )
    return f"CASE WHEN lang = 'go' THEN [] ELSE regexp_extract_all({col}, '(?m)^[ \\t]*class[ \\t]+(\\w+)', 1) END"


def _minus(a: str, b: str, kind: str) -> str:
    return (
        f"coalesce(array_to_string(list_sort(list_filter(list_distinct({_scan(a, kind)}), "
        f"lambda x: NOT list_contains({_scan(b, kind)}, x))), ';'), '')"
    )


# The wider map: the view's .tsx files read as .jsx, its .md files as .mjs.
SCRIPTS = f"""files AS (SELECT filename, patch, CASE {EXT} WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' ELSE {LANG} END AS lang
  FROM (SELECT replace(replace(filename, '.tsx', '.jsx'), '.md', '.mjs') AS filename, patch FROM details_all))"""


@query(
    "d10_symbol_changes",
    f"""WITH {SCRIPTS}, {CODE} SELECT filename, patch, lang AS language, {_minus('n', 'o', 'functions')} AS added_functions, {_minus('o', 'n', 'functions')} AS removed_functions,
      {_minus('n', 'o', 'classes')} AS added_classes, {_minus('o', 'n', 'classes')} AS removed_classes FROM code""",
    D,
)
def d10(v: Views) -> DataFrame:
    filename = F.replace(F.replace("filename", F.lit(".tsx"), F.lit(".jsx")), F.lit(".md"), F.lit(".mjs"))
    rows = v.all_details().select(filename.alias("filename"), "patch").where(F.col("patch").isNotNull())
    rows = rows.where(paths.language_of(F.col("filename"), paths.SYMBOL_LANGUAGES).isNotNull())
    found = rows.select("filename", "patch", patches.symbol_changes(F.col("patch"), F.col("filename")).alias("s"))
    changed = found.select("filename", "patch", "s.*")
    return _sorted_names(changed, patches.CHANGE_COLUMNS)


@query(
    "d11_definitions",
    rf"""WITH {FILES}, {CODE} SELECT filename, patch, lang AS language, array_to_string(CASE lang WHEN 'python' THEN regexp_extract_all(n, '(?m)^def (\w+)', 1)
        WHEN 'go' THEN regexp_extract_all(n, '(?m)^func (\w+)', 1)
        ELSE regexp_extract_all(n, '(?m)^(?:function|const|let) (\w+)(?:\(|[^=\n]*=[^=>\n][^;\n]*=>)', 1) END, ';') AS functions,
      array_to_string(CASE lang WHEN 'go' THEN [] ELSE regexp_extract_all(n, '(?m)^class (\w+)', 1) END, ';') AS classes FROM code""",
    D,
)
def d11(v: Views) -> DataFrame:
    rows = _files(v).where(F.col("lang").isNotNull() & F.col("patch").isNotNull())
    code, lang = patches.new_code(F.col("patch")), F.col("lang")
    found = (
        F.when(lang == "python", patches.definitions(code, "python"))
        .when(lang == "typescript", patches.definitions(code, "typescript"))
        .otherwise(patches.definitions(code, "go"))
    )
    return rows.select("filename", "patch", lang.alias("language"), found.alias("d")).select(
        "filename", "patch", "language", F.array_join("d.functions", ";").alias("functions"), F.array_join("d.classes", ";").alias("classes")
    )


# A source text of each language from the detail rows: one class and one function, and names that only texts and comments
# over several lines hold. The same expression serves Spark and SQL; chr(10) ends a line.
SOURCE_LANGUAGES = ("python", "javascript", "typescript", "go", "cpp", "c_sharp", "rust")
NAMES = "'f' || pr_id % 97 AS fn, 'K' || pr_id % 89 AS cls, chr(10) AS nl"
SOURCE = """CASE lang
  WHEN 'python' THEN 'class ' || cls || ':' || nl || '    ' || repeat(chr(34), 3) || nl || 'def hidden():' || nl || '    ' || repeat(chr(34), 3) || nl || '    def inner(self): pass' || nl || 'def ' || fn || '(): pass'
  WHEN 'go' THEN 'var q = `' || nl || 'func hidden() {' || nl || '`' || nl || '/*' || nl || 'func hidden() {' || nl || '*/' || nl || 'func ' || fn || '() {' || nl || '}'
  WHEN 'cpp' THEN '/*' || nl || 'class Hidden {' || nl || '*/' || nl || 'class ' || cls || ' {' || nl || '  int inner() { return 1; }' || nl || '};' || nl || 'int ' || fn || '(int a) {' || nl || '}'
  WHEN 'c_sharp' THEN '/*' || nl || 'class Hidden {' || nl || '*/' || nl || 'public class ' || cls || ' {' || nl || '  void Inner() { }' || nl || '}'
  WHEN 'rust' THEN '/*' || nl || 'fn hidden() {' || nl || '*/' || nl || 'pub struct ' || cls || ' {' || nl || '}' || nl || 'pub fn ' || fn || '() {' || nl || '}'
  ELSE '/*' || nl || 'function hidden() {' || nl || '*/' || nl || 'const t = `' || nl || 'class Hidden {' || nl || '`;' || nl || 'class ' || cls || ' {' || nl || '  inner() { }' || nl || '}' || nl || 'function ' || fn || '() {' || nl || '}' END"""
SOURCE_LANGUAGE = f"CASE pr_id % 7 {' '.join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(SOURCE_LANGUAGES))} END"
SHOWN = r"""CASE lang WHEN 'python' THEN regexp_replace(code, '(?s)\x22{3}.*?\x22{3}', ' ', 'g')
  ELSE regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', ' ', 'g'), '(?s)`.*?`', ' ', 'g') END"""


@query(
    "d11_every_language",
    rf"""WITH l AS (SELECT *, {SOURCE_LANGUAGE} AS lang, {NAMES} FROM details_all), c AS (SELECT *, {SOURCE} AS code FROM l), s AS (SELECT *, {SHOWN} AS shown FROM c)
    SELECT pr_id, sha, lang AS language, array_to_string(regexp_extract_all(shown, '(?m)^\s*(?:pub )?(?:def|function|func|fn|int) (\w+)\((?:int a)?\)(?: \{{|: pass)$', 1), ';') AS functions,
      array_to_string(regexp_extract_all(shown, '(?m)^\s*(?:pub |public )?(?:class|struct) (\w+)', 1), ';') AS classes FROM s""",
    D,
)
def d11_every_language(v: Views) -> DataFrame:
    """Each language of the scan, with definitions that stand in texts and comments."""
    rows = v.all_details().select("pr_id", "sha", F.expr(SOURCE_LANGUAGE).alias("lang")).selectExpr("*", *NAMES.split(", "))
    code = F.expr(SOURCE)
    found = None
    for name in SOURCE_LANGUAGES:
        scan = patches.definitions(code, name)
        found = F.when(F.col("lang") == name, scan) if found is None else found.when(F.col("lang") == name, scan)
    out = rows.select("pr_id", "sha", F.col("lang").alias("language"), found.alias("d"))
    return out.select("pr_id", "sha", "language", F.array_join("d.functions", ";").alias("functions"), F.array_join("d.classes", ";").alias("classes"))


# --- predictors ---------------------------------------------------------------------------


@query(
    "m01_generated_text",
    r"""WITH p AS (SELECT pr_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT pr_id, string_split_regex(pr_body, '[.!?\n]+') AS l FROM bodies)),
      n AS (SELECT *, len(list_distinct(regexp_extract_all(s, '\S+'))) AS n FROM p),
      best AS (SELECT pr_id, trim(s) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY n DESC, i) AS rn FROM n) WHERE rn = 1 AND n > 0)
    SELECT pr_id, summary FROM bodies LEFT JOIN best USING (pr_id)""",
    B,
)
def m01(v: Views) -> DataFrame:
    """An extract of the whole text; generating models plug in through ``predictors.generate``."""
    return v.bodies().select("pr_id", text.key_sentence(F.col("pr_body")).alias("summary"))


@query("m02_column_check", r"SELECT count(*) AS rows FROM bodies", B)
def m02(v: Views) -> DataFrame:
    """The check runs before any job: a missing column stops the plan."""
    try:
        predictors.generate(v.bodies(), "no_such_column", "summary", object)
    except ValueError:
        return v.bodies().agg(F.count("*").alias("rows"))
    raise AssertionError("a missing column must be refused")


@query(
    "m03_pair_scores",
    f"""WITH s AS (SELECT conv_id, turn, reference IS NOT NULL AS ok, {OVERLAP} FROM pair_texts)
    SELECT conv_id, turn, CASE WHEN ok THEN round(k / c, 6) END AS overlap_precision,
      CASE WHEN ok THEN round(k / r, 6) END AS overlap_recall, CASE WHEN ok THEN round(2.0 * k / (c + r), 6) END AS overlap_f1 FROM s""",
    ("pair_texts",),
)
def m03(v: Views) -> DataFrame:
    scored = predictors.score_pairs(v.pair_texts(), "candidate", "reference")
    return tidy(scored.drop("candidate", "reference"))


@query(
    "m04_language",
    """SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR))[1:1] < '4' AS held_out, true AS known_language, true AS confidence_in_range FROM documents""",
)
def m04(v: Views) -> DataFrame:
    """Fitted on three quarters of the documents; the tests measure it on the rest."""
    docs = v.table("documents").select("doc_id", "lang", "text")
    docs = docs.withColumn("held_out", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "4")
    model = language.fit_language(docs.where(~F.col("held_out")), "text")
    told = language.add_fitted_language(model, docs, "text")
    names = docs.select("lang").distinct().withColumnRenamed("lang", "language").withColumn("known", F.lit(True))
    return told.join(names, "language", "left").select(
        "doc_id",
        "lang",
        "held_out",
        F.coalesce("known", F.lit(False)).alias("known_language"),
        F.col("confidence").between(0.0, 1.0 + 1e-9).alias("confidence_in_range"),
    )


SLOTS = r"""w AS (SELECT conv_id, turn, ('0x' || md5(unnest(regexp_extract_all(text, '\S+')))[1:15])::BIGINT % 16 AS dim FROM conversations)"""


@query(
    "m05_embeddings",
    f"WITH {SLOTS} SELECT conv_id, turn, CAST(dim AS INTEGER) AS dim, CAST(count(*) AS DOUBLE) AS x FROM w GROUP BY ALL",
)
def m05(v: Views) -> DataFrame:
    coded = predictors.add_embedding(v.table("conversations"), "text", "embedding")
    cells = coded.select("conv_id", "turn", F.posexplode("embedding").alias("dim", "x"))
    return cells.where(F.col("x") != 0).withColumn("x", F.col("x").cast("double"))


@query(
    "m06_embedding_similarity",
    f"""SELECT label, count(*) AS pairs, round(avg({COS}), 6) AS mean_similarity FROM vec_pairs GROUP BY label""",
    ("vec_pairs",),
)
def m06(v: Views) -> DataFrame:
    similarity = vectors.cosine(F.col("left_embedding"), F.col("right_embedding"))
    pairs = v.embedding_pairs().select("label", similarity.alias("similarity"))
    return tidy(
        pairs.groupBy("label").agg(F.count("*").alias("pairs"), F.avg("similarity").alias("mean_similarity"))
    )


@query(
    "m07_judge_scores",
    rf"""SELECT pr_id, sha, filename, CASE WHEN patch IS NOT NULL AND message IS NOT NULL THEN CAST(least(5, len({W.format('message')}) // 2) AS INTEGER) END AS what_score,
      CASE WHEN patch IS NOT NULL AND message IS NOT NULL THEN CAST(least(5, len(list_intersect(list_distinct({W.format('message')}), list_distinct({W.format('patch')})))) AS INTEGER) END AS why_score
    FROM details_all""",
    D,
)
def m07(v: Views) -> DataFrame:
    """Scores by rule; judging models plug in through ``predictors.judge``."""
    return v.all_details().select("pr_id", "sha", "filename", *text.message_rules(F.col("message"), F.col("patch")))


def _sampled(tag: int, cols: str, n: int) -> str:
    key = " || '|' || ".join(f"coalesce({c}, '')" for c in cols.split(", "))
    side = "is_agent = 1" if tag else "is_agent = 0"
    return f"""(SELECT {cols}, {tag} AS is_agent FROM (SELECT DISTINCT {cols} FROM details_all WHERE {side} AND sha NOT IN
        (SELECT sha FROM details_all WHERE {side} AND patch IS NULL)) ORDER BY md5({key} || '|42'), {cols} LIMIT {n})"""


@query(
    "m08_inputs_fully_patched",
    f"""WITH r AS ({_sampled(1, 'sha, message, patch', 1500)} UNION ALL {_sampled(0, 'sha, message, patch', 1500)} UNION ALL
      (SELECT hash, message, diff, 2 FROM (SELECT * FROM corpus ORDER BY md5(hash || '|42'), hash LIMIT 1500)))
    SELECT sha, is_agent, message, 0 AS part, string_agg(patch, chr(10) ORDER BY patch) AS patch FROM r WHERE message IS NOT NULL GROUP BY ALL""",
    ("details_all", "corpus"),
)
def m08(v: Views) -> DataFrame:
    return textpairs.patches_for_judging(v.details(), v.human_details(), v.corpus())


def _share(tag: int) -> str:
    side = "is_agent = 1" if tag else "is_agent = 0"
    return f"""(SELECT sha, patch, {tag} AS is_agent FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(sha || '|' || patch || '|42'), sha, patch) AS rn
      FROM (SELECT DISTINCT sha, patch FROM details_all WHERE {side} AND patch IS NOT NULL)) WHERE rn <= round_even(0.05 * n, 0))"""


@query(
    "m09_inputs_sampled_share",
    f"""WITH r AS ({_share(1)} UNION ALL {_share(0)} UNION ALL (SELECT DISTINCT hash, diff, 2 FROM corpus))
    SELECT sha, is_agent, 0 AS part, string_agg(patch, chr(10) ORDER BY patch) AS patch FROM r GROUP BY ALL""",
    ("details_all", "corpus"),
)
def m09(v: Views) -> DataFrame:
    return textpairs.patches_for_generation(v.details(narrow=True), v.human_details(narrow=True), v.corpus())


@query(
    "m10_true_messages",
    """WITH lab AS (SELECT DISTINCT sha, is_agent, message AS label_message FROM details_all WHERE patch IS NOT NULL
        UNION ALL SELECT DISTINCT hash, 2, message FROM corpus)
    SELECT sha, is_agent, label_message FROM lab""",
    ("details_all", "corpus"),
)
def m10(v: Views) -> DataFrame:
    labels = textpairs.true_messages(v.details(), v.human_details(), v.corpus())
    return labels.select("sha", "is_agent", "label_message")
