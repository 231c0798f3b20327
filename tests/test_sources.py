"""Readers, payloads, sinks and the resumable ingest."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from patchloom.sources import payloads, readers, sinks
from patchloom.sources.catalog import SCHEMAS, Catalog
from patchloom.streaming.ingest import ingest_available, payload_stream

TEXTS = [(1, 'say "hi",\nthen go'), (2, " padded "), (3, None), (4, "back\\slash")]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / f"t.{kind}")
    sinks.write_table(spark.createDataFrame(TEXTS, "id LONG, t STRING"), path)
    got = readers.read_table(spark, path, "id LONG, t STRING").orderBy("id").collect()
    assert [tuple(r) for r in got] == TEXTS


def test_json_array_over_several_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"id": 1, "t": "x\ny"}, {"id": 2, "t": None}], indent=2))
    assert readers.read_table(spark, str(path), "id LONG, t STRING", lines=False).count() == 2


@pytest.mark.parametrize("text", ['\n{"x":1}\n{"x":2}\n{"x":3}', '{"x":1}\n\n{"x":2}\n{"x":3}'])
def test_json_lines_keep_every_row(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    assert sorted(r.x for r in readers.read_table(spark, str(path), "x INT").collect()) == [1, 2, 3]


def test_malformed_json_fails_the_read(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('[{"x":1},\n{"x":2}')
    (folder / "b.json").write_text('{"x":3}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_table(spark, str(folder), "x INT").collect()


def test_unsupported_suffix(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.csv", "a INT", allowed=("parquet",))
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), str(tmp_path / "x.txt"))


def test_prompt_literal(spark, tmp_path):
    path = tmp_path / "prompt.md"
    path.write_text("line 1\nline 2")
    assert spark.range(1).select(readers.text_literal(spark, str(path)).alias("p")).first().p == "line 1\nline 2"


def test_catalog_scan_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "related.parquet")
    spark.createDataFrame([(1, 2)], SCHEMAS["related_issue"]).write.parquet(path)
    assert Catalog({"related_issue": path}).scan(spark, "related_issue", ["issue_id"]).columns == ["issue_id"]


PAYLOAD = {
    "sha": "s1",
    "commit": {"message": "m", "author": {"name": "n", "email": "e", "date": "d"}},
    "files": [
        {"filename": "a.py", "status": "added", "additions": 1, "deletions": 0, "changes": 1, "patch": "+x"},
        {"filename": "b.bin", "status": "added", "additions": 0, "deletions": 0, "changes": 0},
    ],
}


def test_commit_payloads(spark):
    rows = [(7, "s1", json.dumps(PAYLOAD)), (7, "s2", json.dumps({"sha": "s2", "files": []})), (7, "s3", json.dumps({"sha": "s3"}))]
    got = payloads.commit_files(spark.createDataFrame(rows, "pr_id LONG, sha STRING, payload STRING")).orderBy("file").collect()
    assert [(r.pr_id, r.sha, r.file, r.patch, r.author) for r in got] == [(7, "s1", "a.py", "+x", "n"), (7, "s1", "b.bin", None, "n")]
    listed = spark.createDataFrame([(json.dumps([{"sha": "a"}, {"sha": None}, {}, {"sha": ""}]),)], "p STRING")
    assert listed.select(payloads.commit_shas(F.col("p")).alias("s")).first().s == ["a"]


KEYED = "pr_id LONG, sha STRING, file STRING, status STRING"


def test_upsert_keeps_existing_rows_and_repeats_nothing(spark, tmp_path):
    path = str(tmp_path / "out.parquet")
    first = spark.createDataFrame([(1, "a", "f", "old"), (1, "a", None, "old")], KEYED)
    second = spark.createDataFrame([(1, "a", "f", "new"), (1, "a", None, "new"), (2, "b", "f", "x"), (2, "b", "f", "y")], KEYED)
    assert sinks.existing_table(spark, path) is None
    assert sinks.upsert_counted(spark, first, path).added == 2
    counts = sinks.upsert_counted(spark, second, path)
    assert (counts.incoming, counts.added, counts.duplicates) == (4, 1, 3)
    assert sinks.upsert_counted(spark, second, path).added == 0
    got = sorted((r.pr_id, r.file or "", r.status) for r in spark.read.parquet(path).collect())
    assert got == [(1, "", "old"), (1, "f", "old"), (2, "f", "x")]
    assert sinks.read_keyed(spark, path).columns == ["pr_id", "sha", "file", "status"]
    with pytest.raises(ValueError):
        sinks.upsert_append(spark, second, path, buckets=8)


def test_upsert_reads_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "out.parquet")
    rows = spark.range(200).selectExpr("id AS pr_id", "'s' AS sha", "'f' AS file", "'x' AS status")
    assert sinks.upsert_append(spark, rows, path) == 200
    batch = sinks._bucketed(rows.where("pr_id = 7"), "pr_id", sinks.BUCKETS)
    plan = sinks.touched_rows(spark.read.parquet(path), batch, sinks.BUCKETS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket_64" in text or "PartitionFilters: [isnotnull(bucket_64" in text
    assert {r.bucket_64 for r in plan.collect()} == {r.bucket_64 for r in batch.collect()}


def test_remaining_work(spark):
    work = spark.createDataFrame([(1,), (2,)], "pr_id LONG")
    assert sinks.remaining(work, None).count() == 2
    assert sinks.remaining(work, spark.range(3)).count() == 2  # no key column: everything
    assert [r.pr_id for r in sinks.remaining(work, work.where("pr_id = 1")).collect()] == [2]


def test_ingest_resumes(spark, tmp_path):
    landed, out, mark = (str(tmp_path / n) for n in ("landed", "out.parquet", "mark"))

    def land(pr, sha):
        rows = [(pr, sha, json.dumps({**PAYLOAD, "sha": sha}))]
        spark.createDataFrame(rows, "pr_id LONG, sha STRING, payload STRING").write.mode("append").json(landed)

    def run():
        source = payload_stream(spark, landed, "pr_id LONG, sha STRING, payload STRING")
        ingest_available(spark, source, out, mark, payloads.commit_files)
        return spark.read.parquet(out).count()

    land(1, "s1")
    assert run() == 2
    land(1, "s1")  # the same commit again
    land(2, "s2")
    assert run() == 4
    assert run() == 4
