"""Scans (S) and sinks (K). Whatever is written goes to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.session import scratch_dir, shuffles_freed
from patchloom.sources import payloads
from patchloom.sources.catalog import Catalog
from patchloom.sources.readers import read_table, read_whole_text
from patchloom.sources.sinks import (
    existing_table,
    remaining,
    read_keyed,
    upsert_append,
    upsert_counted,
    write_table,
)
from patchloom.sources.snapshots import SnapshotTable
from patchloom.streaming.ingest import ingest_available, ingest_keyed, payload_stream
from patchloom.workload.registry import query
from patchloom.workload.views import Views

D, P = ("details_all",), ("pr_all",)


@query("s1_scan_by_uri", "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_quantity > 40")
def s1(v: Views) -> DataFrame:
    uri = v.dir if "://" in v.dir else f"file://{v.dir}"
    catalog = Catalog({"lineitem": f"{uri}/lineitem.parquet"})
    rows = catalog.scan(v.spark, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"])
    return rows.where(F.col("l_quantity") > 40).drop("l_quantity")


@query("s2_scan_parquet", "SELECT doc_id, lang, n_chars FROM documents")
def s2(v: Views) -> DataFrame:
    return read_table(v.spark, f"{v.dir}/documents.parquet").select("doc_id", "lang", "n_chars")


CORPUS = "hash STRING, diff STRING, message STRING, diff_languages STRING"


@query("s3_scan_csv", "SELECT * FROM corpus", ("corpus",))
def s3(v: Views) -> DataFrame:
    """Texts with line breaks and quotes through a CSV file."""
    path = f"{scratch_dir(v.spark, 's3')}/corpus.csv"
    write_table(v.corpus(), path)
    return read_table(v.spark, path, CORPUS)


@query("s4_scan_json", "SELECT * FROM corpus", ("corpus",))
def s4(v: Views) -> DataFrame:
    path = f"{scratch_dir(v.spark, 's4')}/corpus.json"
    write_table(v.corpus(), path)
    return read_table(v.spark, path, CORPUS)


@query("s5_scan_by_suffix", "SELECT CAST(hash AS VARCHAR) AS hash, 'csv' AS kind FROM corpus UNION ALL SELECT hash, 'json' FROM corpus", ("corpus",))
def s5(v: Views) -> DataFrame:
    out = None
    for kind in ("csv", "json"):
        path = f"{scratch_dir(v.spark, 's5')}/corpus.{kind}"
        write_table(v.corpus().select("hash"), path)
        rows = read_table(v.spark, path, "hash STRING").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    try:
        read_table(v.spark, f"{v.dir}/corpus.xlsx")
    except ValueError:
        return out
    raise AssertionError("an unsupported suffix must be refused")


def commit_payloads(v: Views) -> DataFrame:
    """Commit payloads as an API returns them, one per file row; without a patch the file list is empty."""
    rows = v.all_details(narrow=True)
    author = F.struct(
        F.concat(F.lit("dev"), F.col("pr_id") % 20).alias("name"),
        F.concat(F.lit("dev"), F.col("pr_id") % 20, F.lit("@mail.example")).alias("email"),
        F.lit("2024-05-01T00:00:00Z").alias("date"),
    )
    one = F.array(F.struct("filename", "status", "additions", "deletions", "changes", "patch"))
    files = F.when(F.col("patch").isNotNull(), one).otherwise(F.slice(one, 1, 0))
    body = F.struct("sha", F.struct("message", author.alias("author")).alias("commit"), files.alias("files"))
    return rows.select("pr_id", "sha", F.to_json(body).alias("payload"))


FLAT = """SELECT sha, pr_id, filename AS file, status, additions, deletions, changes, patch, message,
  'dev' || (pr_id % 20) AS author, 'dev' || (pr_id % 20) || '@mail.example' AS author_email, '2024-05-01T00:00:00Z' AS date
  FROM details_all WHERE patch IS NOT NULL"""


@query("s6_commit_payload_rows", FLAT, D)
def s6(v: Views) -> DataFrame:
    return payloads.commit_files(commit_payloads(v))


@query("s7_commit_list_shas", "SELECT pr_id, sha FROM commits", ("commits",))
def s7(v: Views) -> DataFrame:
    listed = F.to_json(
        F.array(F.struct(F.col("sha").alias("sha")), F.struct(F.lit(None).cast("string").alias("sha")))
    )
    rows = v.commits().select("pr_id", listed.alias("payload"))
    return rows.select("pr_id", F.explode(payloads.commit_shas(F.col("payload"))).alias("sha"))


@query(
    "s8_work_list",
    """SELECT id AS pr_id, number AS pr_number, string_split(repo_url, '/')[-2] || '/' || string_split(repo_url, '/')[-1] AS repo
    FROM pr_all WHERE agent = 'Human'""",
    P,
)
def s8(v: Views) -> DataFrame:
    return payloads.work_list(v.human_pr())


@query("s9_whole_text", "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents")
def s9(v: Views) -> DataFrame:
    """Whole files as rows: all characters of the documents, with one line end each."""
    path = scratch_dir(v.spark, "s9")
    v.table("documents").select("text").write.option("maxRecordsPerFile", 1000).text(path)
    return read_whole_text(v.spark, path).agg(F.sum(F.length("value")).alias("chars"))


# --- sinks ------------------------------------------------------------------------------------


@query("k1_parquet_overwrite", "SELECT pr_id, sha, message FROM commits", ("commits",))
def k1(v: Views) -> DataFrame:
    path = f"{scratch_dir(v.spark, 'k1')}/commits.parquet"
    for _ in range(2):
        write_table(v.commits(), path)
    return v.spark.read.parquet(path)


@query(
    "k2_csv_and_json_sink",
    "SELECT pr_id, pr_body, 'csv' AS kind FROM bodies UNION ALL SELECT pr_id, pr_body, 'json' FROM bodies",
    ("bodies",),
)
def k2(v: Views) -> DataFrame:
    out = None
    for kind in ("csv", "json"):
        path = f"{scratch_dir(v.spark, 'k2')}/bodies.{kind}"
        write_table(v.bodies().select("pr_id", "pr_body"), path)
        rows = read_table(v.spark, path, "pr_id LONG, pr_body STRING").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def _file_rows(v: Views) -> DataFrame:
    return v.all_details().select("pr_id", "sha", F.col("filename").alias("file"), "status")


UPSERTED = """WITH old AS (SELECT pr_id, sha, filename, min(status) AS status FROM details_all WHERE status = 'modified' GROUP BY ALL),
  fresh AS (SELECT pr_id, sha, filename, min(status) AS status FROM details_all GROUP BY ALL)
  SELECT pr_id, sha, filename AS file, coalesce(old.status, fresh.status) AS status FROM fresh LEFT JOIN old USING (pr_id, sha, filename)"""


@query("k3_upsert_existing_wins", UPSERTED, D)
def k3(v: Views) -> DataFrame:
    """Modified rows first, then everything, twice: existing rows win and a repeat adds nothing."""
    path = f"{scratch_dir(v.spark, 'k3')}/details.parquet"
    rows = _file_rows(v)
    upsert_append(v.spark, rows.where(F.col("status") == "modified"), path)
    for _ in range(2):
        upsert_append(v.spark, rows, path)
    return read_keyed(v.spark, path)


@query("k3_atomic_commits", UPSERTED, D)
def k3_atomic(v: Views) -> DataFrame:
    """As k3, with appends that become visible whole; a batch repeated by name adds nothing."""
    table = SnapshotTable(v.spark, f"{scratch_dir(v.spark, 'k3-atomic')}/details")
    rows = _file_rows(v)
    table.append(rows.where(F.col("status") == "modified"), "load", 0)
    for batch in (1, 1, 2):
        table.append(rows, "load", batch)
    return table.rows()


@query(
    "k4_remaining_work",
    "SELECT id AS pr_id FROM pr_all WHERE id NOT IN (SELECT pr_id FROM details_all WHERE status = 'added')",
    ("details_all", "pr_all"),
)
def k4(v: Views) -> DataFrame:
    path = f"{scratch_dir(v.spark, 'k4')}/done.parquet"
    work = v.all_prs().select(F.col("id").alias("pr_id"))
    assert existing_table(v.spark, path) is None
    write_table(_file_rows(v).where(F.col("status") == "added"), path)
    return remaining(work, existing_table(v.spark, path))


# Rows per landed file. Compressed files are not split, so their size bounds what one task reads.
LANDED_ROWS = 250_000


def land(lot: DataFrame, folder: str) -> None:
    """Payload files as gzip JSON Lines: as plain text they are several times the size of the table made of them."""
    with shuffles_freed(lot.sparkSession):
        lot.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", LANDED_ROWS).json(folder)


@query(
    "k5_resumable_ingest",
    """SELECT pr_id, sha, filename AS file, min(status) AS status, count(*) > 0 AS seen FROM details_all WHERE patch IS NOT NULL
    GROUP BY pr_id, sha, filename""",
    D,
)
def k5(v: Views) -> DataFrame:
    """Payload files landed in two lots; the job runs after each and once more for nothing."""
    base = scratch_dir(v.spark, "k5")
    landed, table, checkpoint = f"{base}/landed", f"{base}/details.parquet", f"{base}/checkpoint"
    lots = commit_payloads(v)
    for lot in (lots.where(F.col("pr_id") % 2 == 0), lots.where(F.col("pr_id") % 2 == 1), None):
        if lot is not None:
            land(lot, landed)
        source = payload_stream(v.spark, landed, "pr_id LONG, sha STRING, payload STRING")
        ingest_available(v.spark, source, table, checkpoint, payloads.commit_files)
    kept = read_keyed(v.spark, table)
    return kept.select("pr_id", "sha", "file", "status", F.lit(True).alias("seen"))


@query(
    "k5_atomic_ingest",
    """SELECT pr_id, sha, filename AS file, min(status) AS status FROM details_all WHERE patch IS NOT NULL GROUP BY pr_id, sha, filename""",
    D,
)
def k5_atomic(v: Views) -> DataFrame:
    """Payload files landed in two lots, each batch one version of the table."""
    base = scratch_dir(v.spark, "k5-atomic")
    landed, checkpoint = f"{base}/landed", f"{base}/checkpoint"
    lots = commit_payloads(v)
    for lot in (lots.where(F.col("pr_id") % 2 == 0), lots.where(F.col("pr_id") % 2 == 1)):
        land(lot, landed)
        source = payload_stream(v.spark, landed, "pr_id LONG, sha STRING, payload STRING")
        ingest_available(v.spark, source, f"{base}/details", checkpoint, payloads.commit_files, atomic=True)
    return SnapshotTable(v.spark, f"{base}/details").rows().select("pr_id", "sha", "file", "status")


@query(
    "k5_keyed_state",
    """SELECT pr_id, sha, filename AS file, (SELECT count(DISTINCT (pr_id, sha, filename)) FROM details_all WHERE patch IS NOT NULL) AS keys
    FROM details_all WHERE patch IS NOT NULL GROUP BY pr_id, sha, filename""",
    D,
)
def k5_keyed_state(v: Views) -> DataFrame:
    """Two lots, of which the second brings the first once more; the keys seen are the query's state.

    Rows of one key in one batch differ in status here; any one of them stays, so keys are returned without it."""
    base = scratch_dir(v.spark, "k5-state")
    landed, table, checkpoint = f"{base}/landed", f"{base}/details.parquet", f"{base}/checkpoint"
    lots = commit_payloads(v)
    keys = 0
    for lot in (lots.where(F.col("pr_id") % 2 == 0), lots):
        land(lot, landed)
        source = payload_stream(v.spark, landed, "pr_id LONG, sha STRING, payload STRING")
        keys = ingest_keyed(source, table, checkpoint, payloads.commit_files, state_partitions=8)
    return v.spark.read.parquet(table).select("pr_id", "sha", "file", F.lit(keys).cast("long").alias("keys"))


@query(
    "k6_upsert_counters",
    """SELECT count(*) AS incoming, count(DISTINCT (pr_id, sha, filename)) - (SELECT count(DISTINCT (pr_id, sha, filename)) FROM details_all WHERE status = 'modified') AS added
    FROM details_all""",
    D,
)
def k6(v: Views) -> DataFrame:
    path = f"{scratch_dir(v.spark, 'k6')}/details.parquet"
    rows = _file_rows(v)
    upsert_append(v.spark, rows.where(F.col("status") == "modified"), path)
    counts = upsert_counted(v.spark, rows, path)
    return v.spark.createDataFrame([(counts.incoming, counts.added)], "incoming LONG, added LONG")
