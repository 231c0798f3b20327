"""Pull-request tables derived from the supplied tables, once for Spark and once as SQL.

The two texts are written independently of each other: the second is what an oracle reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.session import prepare

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Schemas of the supplied tables: a declared schema saves the footer read of every scan.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    "labels": "doc_id LONG, quality INT, toxic INT",
    "embeddings": "vec_id LONG, embedding ARRAY<FLOAT>, label INT",
    "benchmark": "item_id LONG, text STRING",
    "pages": "page_id LONG, url STRING, html STRING",
    "conversations": "conv_id LONG, turn LONG, role STRING, text STRING",
}
PR_COLUMNS = ("id", "agent", "title", "repo_id", "html_url", "state", "created_at", "closed_at", "merged_at")
HUMAN_PR_COLUMNS = (
    "id", "number", "agent", "title", "repo_url", "html_url", "state", "created_at", "closed_at", "merged_at",
)
DETAIL_COLUMNS = ("pr_id", "sha", "filename", "status", "additions", "deletions", "changes", "patch", "message")


class Views:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def _once(self, name: str, build) -> DataFrame:
        """Build a view's plan once; several views start from it."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def table(self, name: str) -> DataFrame:
        return self._once(
            name, lambda: self.spark.read.schema(TABLES[name]).parquet(f"{self.dir}/{name}.parquet")
        )

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Chosen columns of a table; how it is split follows from how it was written."""
        return self.table(name).select(*columns)

    def _agent(self) -> Column:
        priority = F.col("o_orderpriority")
        return (
            F.when(priority.isin("1-URGENT", "2-HIGH"), "Human")
            .when((priority == "3-MEDIUM") & (F.col("o_custkey") % 10 == 3), F.lit(None))
            .otherwise(priority)
        )

    def all_prs(self) -> DataFrame:
        return self._once("all_prs", self._all_prs)

    def _all_prs(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        done = F.col("o_orderdate") + F.make_dt_interval((key % 40).cast("int"), (key % 24).cast("int"))
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            key.alias("id"),
            (key % 1000).alias("number"),
            self._agent().alias("agent"),
            F.when(cust % 11 != 5, F.concat(F.lit("Update "), F.lower("o_orderpriority"), F.lit(" change "), key)).alias(
                "title"
            ),
            (cust % 50).alias("repo_id"),
            F.concat(F.lit("https://git.example/api/repos/team"), cust % 7, F.lit("/project"), cust % 50).alias(
                "repo_url"
            ),
            F.concat(F.lit("https://git.example/team"), cust % 7, F.lit("/pull/"), key).alias("html_url"),
            status.alias("state"),
            F.date_format("o_orderdate", ISO).alias("created_at"),
            F.when(status != "O", F.date_format(done, ISO)).alias("closed_at"),
            F.when(status == "F", F.date_format(done, ISO)).alias("merged_at"),
        )

    def pr(self) -> DataFrame:
        df = self.all_prs()
        return df.where(F.col("agent").isNull() | (F.col("agent") != "Human")).select(*PR_COLUMNS)

    def human_pr(self) -> DataFrame:
        return self.all_prs().where(F.col("agent") == "Human").select(*HUMAN_PR_COLUMNS)

    def all_details(self, narrow: bool = False) -> DataFrame:
        """File rows, which lie by pull request where tables are too large for a broadcast. With ``narrow`` the parts are
        joined last: their texts are not shuffled beside the rows, which then lie by part."""
        return self._once(f"all_details {narrow}", lambda: self._all_details(narrow))

    def _all_details(self, narrow: bool) -> DataFrame:
        owner = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        rows = self.spread(
            "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"
        )
        joins = [(part, F.col("l_partkey") == F.col("p_partkey")), (owner, F.col("l_orderkey") == F.col("o_orderkey"))]
        for table, same in reversed(joins) if narrow else joins:
            rows = rows.join(table, same)
        kind = F.col("p_partkey") % 9
        base = F.replace("p_name", F.lit(" "), F.lit("_"))
        ext = F.try_element_at(
            F.array(*[F.lit(x) for x in (".py", ".ts", ".go", ".md", ".PYI", ".tsx", ".py")]), (kind + 1).cast("int")
        )
        filename = (
            F.when(kind == 8, base)
            .when(kind == 7, F.concat(F.lit("."), base))
            .otherwise(F.concat("p_type", F.lit("/"), "p_brand", F.lit("/"), base, ext))
        )
        flag = F.col("l_returnflag")
        additions = F.col("l_quantity").cast("bigint")
        deletions = F.round(F.col("l_discount") * 100).cast("bigint")
        return rows.select(
            F.col("l_orderkey").alias("pr_id"),
            F.md5(F.concat("l_orderkey", F.lit("-"), "l_linenumber")).alias("sha"),
            filename.alias("filename"),
            F.when(flag == "A", "added").when(flag == "N", "modified").otherwise("removed").alias("status"),
            additions.alias("additions"),
            deletions.alias("deletions"),
            (additions + deletions).alias("changes"),
            self._patch(kind).alias("patch"),
            F.when(
                (F.col("l_linenumber") != 7) | (F.col("l_orderkey") % 3 != 0),
                F.concat(
                    F.lit("Commit "), "l_linenumber", F.lit(" of change "), "l_orderkey",
                    F.repeat(F.lit(" more"), (F.col("l_orderkey") % 5).cast("int")),
                ),
            ).alias("message"),
            self._agent().alias("agent"),
        )

    def _patch(self, kind: Column) -> Column:
        sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("+")
        other = F.when(F.col("l_returnflag") == "N", "-").otherwise("+")
        name = F.concat(F.lit("f"), F.col("p_partkey") % 300, F.lit("_r"), F.col("o_custkey") % 50)
        old = F.concat(F.lit("f"), (F.col("p_partkey") + F.col("l_linenumber")) % 300, F.lit("_r"), F.col("o_custkey") % 50)
        shape = F.col("l_linenumber") % 3
        python = F.concat_ws(
            "\n",
            F.concat(sign, F.lit("def "), name, F.lit("(a, b):")),
            F.concat(sign, F.lit("    return a")),
            F.concat(other, F.lit("class K"), old, F.lit("(Base):")),
            F.concat(other, F.lit("    def inner(self):")),
        )
        typescript = F.concat_ws(
            "\n",
            F.when(shape == 0, F.concat(sign, F.lit("function "), name, F.lit("(a) {")))
            .when(shape == 1, F.concat(sign, F.lit("const "), name, F.lit(" = (a) => {")))
            .otherwise(F.concat(sign, F.lit("let "), name, F.lit(": Fn = a => {"))),
            F.concat(other, F.lit("class K"), old, F.lit(" {")),
            F.concat(sign, F.lit("const x = 1;")),
        )
        go = F.concat_ws(
            "\n",
            F.concat(sign, F.lit("func "), name, F.lit("(a int) int {")),
            F.concat(other, F.lit("func (t *T) "), old, F.lit("() {")),
        )
        body = (
            F.when(kind.isin(0, 4, 6), python).when(kind.isin(1, 5), typescript).when(kind == 2, go).otherwise("+text")
        )
        head = F.concat(F.lit("@@ -1,"), F.col("l_linenumber"), F.lit(" +1,9 @@"))
        lines = F.concat_ws("\n", head, F.lit("--- a/file"), F.lit("+++ b/file"), body, F.lit(" context"), F.lit("++i;"))
        return F.when(F.col("p_partkey") % 13 != 6, lines)

    def details(self, narrow: bool = False) -> DataFrame:
        df = self.all_details(narrow)
        return df.where(F.col("agent").isNull() | (F.col("agent") != "Human")).select(*DETAIL_COLUMNS)

    def human_details(self, narrow: bool = False) -> DataFrame:
        named = [F.col(c).alias("file") if c == "filename" else F.col(c) for c in DETAIL_COLUMNS]
        return self.all_details(narrow).where(F.col("agent") == "Human").select(*named)

    def change_table(self) -> DataFrame:
        from patchloom.plans.change_size import change_table

        return change_table(self.pr(), self.details(), self.human_pr(), self.human_details())

    def _types(self, human: bool) -> DataFrame:
        priority = F.col("o_orderpriority")
        side = priority.isin("1-URGENT", "2-HIGH") if human else ~priority.isin("1-URGENT", "2-HIGH")
        labels = F.array(*[F.lit(x) for x in ("feat", "fix", "docs", "test", "build", "chore")])
        kind = F.try_element_at(labels, (F.col("o_custkey") % 7 + 1).cast("int"))
        return self.table("orders").where(side).select(F.col("o_orderkey").alias("id"), kind.alias("type"))

    def agent_types(self) -> DataFrame:
        return self._types(False)

    def human_types(self) -> DataFrame:
        return self._types(True)

    def bodies(self) -> DataFrame:
        """pr_id, pr_title, pr_body from whole document texts."""
        key = F.col("doc_id")
        fence = "\n```python\nprint(1)\n```\n"
        tails = [
            "\n## Summary\nThis fixes #12 and RELATED TO: AB-7\n",
            "\n- [x] done\n* [ ] open\nDescription of it\n## summary\n",
            fence,
            "\nCloses ABC-77\n```\na b\n``` and ```c```\nMotivation\n\nContext: x\n",
            "",
        ]
        tail = F.try_element_at(F.array(*[F.lit(t) for t in tails]), (key % 5 + 1).cast("int"))
        body = F.when(key % 12 == 5, F.lit(None)).when(key % 12 == 7, F.lit(" \n ")).otherwise(F.concat("text", tail))
        return self.spread("documents", "doc_id", "text", "source").select(
            key.alias("pr_id"),
            F.when(key % 9 != 4, F.concat(F.lit("Work on  "), "source", F.lit(" "), key)).alias("pr_title"),
            body.alias("pr_body"),
        )

    def commits(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("pr_id"),
            F.md5(F.concat("conv_id", F.lit("-"), "turn")).alias("sha"),
            F.when(F.col("role") != "system", F.col("text")).alias("message"),
        )

    def related_issues(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("pr_id"),
            F.when(F.col("event_type") != "error", F.col("event_id")).alias("issue_id"),
        )

    def corpus(self) -> DataFrame:
        """Benchmark commit corpus from documents: hash, diff, message, language."""
        return self.spread("documents", "doc_id", "text", "source", "lang").select(
            F.md5(F.col("doc_id").cast("string")).alias("hash"),
            F.concat(F.lit("+"), "text").alias("diff"),
            F.concat(F.lit("Add "), "source", F.lit(" page "), "doc_id").alias("message"),
            F.col("lang").alias("diff_languages"),
        )

    def pair_texts(self) -> DataFrame:
        """Candidate and reference texts: what a turn says and what the turn before it said."""
        turns = self.spread("conversations", "conv_id", "turn", "text")
        left = turns.select("conv_id", "turn", F.col("text").alias("candidate"))
        right = self.table("conversations").select(
            "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference")
        )
        return left.join(right, on=["conv_id", "turn"], how="left")

    def embedding_pairs(self) -> DataFrame:
        """Vectors 2k and 2k+1 side by side, with a group label."""
        e = self.table("embeddings")
        half = F.expr("vec_id div 2")
        left = e.where(F.col("vec_id") % 2 == 0).select(
            half.alias("pr_id"), F.col("embedding").alias("left_embedding"), F.col("label")
        )
        right = e.where(F.col("vec_id") % 2 == 1).select(half.alias("pr_id"), F.col("embedding").alias("right_embedding"))
        return left.join(right, on="pr_id")


_PRIORITY_AGENT = """CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Human'
    WHEN o_orderpriority = '3-MEDIUM' AND o_custkey % 10 = 3 THEN NULL ELSE o_orderpriority END"""

_DONE = "o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) + to_hours(CAST(o_orderkey % 24 AS INTEGER))"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"

VIEW_SQL: dict[str, str] = {
    "pr_all": f"""SELECT o_orderkey AS id, o_orderkey % 1000 AS number, {_PRIORITY_AGENT} AS agent,
    CASE WHEN o_custkey % 11 <> 5 THEN 'Update ' || lower(o_orderpriority) || ' change ' || o_orderkey END AS title,
    o_custkey % 50 AS repo_id,
    'https://git.example/api/repos/team' || (o_custkey % 7) || '/project' || (o_custkey % 50) AS repo_url,
    'https://git.example/team' || (o_custkey % 7) || '/pull/' || o_orderkey AS html_url,
    o_orderstatus AS state, strftime(o_orderdate, {_ISO}) AS created_at,
    CASE WHEN o_orderstatus <> 'O' THEN strftime({_DONE}, {_ISO}) END AS closed_at,
    CASE WHEN o_orderstatus = 'F' THEN strftime({_DONE}, {_ISO}) END AS merged_at,
    CASE WHEN o_orderstatus = 'F' THEN {_DONE} END AS merged_ts,
    CASE WHEN {_PRIORITY_AGENT} = 'Human' THEN 0 ELSE 1 END AS is_agent
  FROM orders""",
    "details_all": """SELECT l_orderkey AS pr_id, md5(l_orderkey || '-' || l_linenumber) AS sha,
    CASE p_partkey % 9 WHEN 8 THEN replace(p_name, ' ', '_') WHEN 7 THEN '.' || replace(p_name, ' ', '_')
      ELSE p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_')
        || (CASE p_partkey % 9 WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.md' WHEN 4 THEN '.PYI'
            WHEN 5 THEN '.tsx' ELSE '.py' END) END AS filename,
    CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'removed' END AS status,
    CAST(trunc(l_quantity) AS BIGINT) AS additions, CAST(round(l_discount * 100) AS BIGINT) AS deletions,
    CAST(trunc(l_quantity) AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) AS changes,
    CASE WHEN p_partkey % 13 <> 6 THEN concat_ws(chr(10), '@@ -1,' || l_linenumber || ' +1,9 @@', '--- a/file', '+++ b/file',
      CASE WHEN p_partkey % 9 IN (0, 4, 6) THEN
          concat_ws(chr(10), sg || 'def ' || nm || '(a, b):', sg || '    return a',
                    ot || 'class K' || od || '(Base):', ot || '    def inner(self):')
        WHEN p_partkey % 9 IN (1, 5) THEN
          concat_ws(chr(10), CASE l_linenumber % 3 WHEN 0 THEN sg || 'function ' || nm || '(a) {'
                      WHEN 1 THEN sg || 'const ' || nm || ' = (a) => {' ELSE sg || 'let ' || nm || ': Fn = a => {' END,
                    ot || 'class K' || od || ' {', sg || 'const x = 1;')
        WHEN p_partkey % 9 = 2 THEN
          concat_ws(chr(10), sg || 'func ' || nm || '(a int) int {', ot || 'func (t *T) ' || od || '() {')
        ELSE '+text' END, ' context', '++i;') END AS patch,
    CASE WHEN l_linenumber <> 7 OR l_orderkey % 3 <> 0 THEN 'Commit ' || l_linenumber || ' of change ' || l_orderkey
      || repeat(' more', CAST(l_orderkey % 5 AS INTEGER)) END AS message, agent,
    CASE WHEN agent = 'Human' THEN 0 ELSE 1 END AS is_agent
  FROM (SELECT *, """
    + _PRIORITY_AGENT
    + """ AS agent,
      CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS sg, CASE WHEN l_returnflag = 'N' THEN '-' ELSE '+' END AS ot,
      'f' || (p_partkey % 300) || '_r' || (o_custkey % 50) AS nm,
      'f' || ((p_partkey + l_linenumber) % 300) || '_r' || (o_custkey % 50) AS od
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    "change_rows": """SELECT p.id AS pr_id, p.agent, p.is_agent, p.created_at, p.state,
    CASE WHEN p.merged_at IS NULL THEN 0 ELSE 1 END AS is_merged, substr(p.created_at, 1, 7) AS created_at_ym,
    d.sha, d.filename, d.status, d.additions, d.deletions, d.changes,
    CASE WHEN len(string_split(d.filename, '/')) >= 2 THEN string_split(d.filename, '/')[-2] END AS module_l1,
    CASE WHEN len(string_split(d.filename, '/')) >= 3 THEN string_split(d.filename, '/')[-3] END AS module_l2
  FROM pr_all p JOIN details_all d ON p.id = d.pr_id WHERE p.closed_at IS NOT NULL""",
    "types_all": """SELECT o_orderkey AS pr_id, CASE o_custkey % 7 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'docs'
    WHEN 3 THEN 'test' WHEN 4 THEN 'build' WHEN 5 THEN 'chore' END AS task_type,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0 ELSE 1 END AS is_agent FROM orders""",
    "bodies": """SELECT doc_id AS pr_id,
    CASE WHEN doc_id % 9 <> 4 THEN 'Work on  ' || source || ' ' || doc_id END AS pr_title,
    CASE WHEN doc_id % 12 = 5 THEN NULL WHEN doc_id % 12 = 7 THEN ' ' || chr(10) || ' ' ELSE text || CASE doc_id % 5
      WHEN 0 THEN chr(10) || '## Summary' || chr(10) || 'This fixes #12 and RELATED TO: AB-7' || chr(10)
      WHEN 1 THEN chr(10) || '- [x] done' || chr(10) || '* [ ] open' || chr(10) || 'Description of it' || chr(10)
        || '## summary' || chr(10)
      WHEN 2 THEN chr(10) || '```python' || chr(10) || 'print(1)' || chr(10) || '```' || chr(10)
      WHEN 3 THEN chr(10) || 'Closes ABC-77' || chr(10) || '```' || chr(10) || 'a b' || chr(10) || '``` and ```c```'
        || chr(10) || 'Motivation' || chr(10) || chr(10) || 'Context: x' || chr(10)
      ELSE '' END END AS pr_body FROM documents""",
    "commits": """SELECT conv_id AS pr_id, md5(conv_id || '-' || turn) AS sha,
    CASE WHEN role <> 'system' THEN text END AS message FROM conversations""",
    "related": """SELECT user_id AS pr_id, CASE WHEN event_type <> 'error' THEN event_id END AS issue_id FROM events""",
    "corpus": """SELECT md5(CAST(doc_id AS VARCHAR)) AS hash, '+' || text AS diff,
    'Add ' || source || ' page ' || doc_id AS message, lang AS diff_languages FROM documents""",
    "pair_texts": """SELECT a.conv_id, a.turn, a.text AS candidate, b.text AS reference
    FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""",
    "vec_pairs": """SELECT a.vec_id // 2 AS pr_id, a.embedding AS l, b.embedding AS r, a.label
    FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id WHERE a.vec_id % 2 = 0""",
}

_NEEDS = {"change_rows": ["pr_all", "details_all"]}


def with_views(sql: str, *names: str) -> str:
    """Put the named views in front of a statement that may start with its own CTEs."""
    wanted: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    head = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in wanted)
    body = sql.strip()
    if not wanted:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
