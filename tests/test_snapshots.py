"""Atomic keyed appends: killed appends, two writers on one version, repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patchloom.plans.classify import fit_model, scored
from patchloom.sources import sinks
from patchloom.sources.snapshots import SnapshotTable

KEYED = "pr_id LONG, sha STRING, file STRING, status STRING"


def rows_of(table):
    return sorted((r.pr_id, r.file or "", r.status) for r in table.rows().collect())


def frame(spark, *rows):
    return spark.createDataFrame([(i, "s", f, status) for i, f, status in rows], KEYED)


def test_existing_rows_win_and_repeats_add_nothing(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.rows() is None and table.current().version == 0
    assert table.append(frame(spark, (1, "f", "old"), (1, None, "old"))) == 2
    assert table.append(frame(spark, (1, "f", "new"), (1, None, "new"), (2, "f", "y"), (2, "f", "x"))) == 1
    assert table.append(frame(spark, (2, "f", "z"))) == 0
    assert table.append(frame(spark)) == 0
    assert rows_of(table) == [(1, "", "old"), (1, "f", "old"), (2, "f", "x")]
    assert table.current().version == 2 and table.current().rows == 3 and not table.leftovers()
    assert sorted(r.pr_id for r in table.rows(table.at(1)).collect()) == [1, 1]


def test_killed_append_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.append(frame(spark, (1, "f", "old")))

    def dies(snapshot):
        raise RuntimeError("killed between data and list")

    monkeypatch.setattr(table, "publish", dies)
    with pytest.raises(RuntimeError):
        table.append(frame(spark, (2, "f", "lost"), (3, "f", "lost")))
    again = SnapshotTable(spark, str(tmp_path / "t"))
    assert rows_of(again) == [(1, "f", "old")] and len(again.leftovers()) == 1
    assert again.append(frame(spark, (2, "f", "kept"), (3, "f", "kept"))) == 2
    assert rows_of(again) == [(1, "f", "old"), (2, "f", "kept"), (3, "f", "kept")]
    with pytest.raises(Exception, match="boom"):
        again.append(frame(spark, (4, "f", "x")).withColumn("status", F.expr("CASE WHEN pr_id = 4 THEN raise_error('boom') ELSE status END")))
    assert len(rows_of(again)) == 3


def test_two_writers_on_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    SnapshotTable(spark, path).append(frame(spark, (0, "f", "base")))
    slow, fast = SnapshotTable(spark, path), SnapshotTable(spark, path)
    publish, tries = slow.publish, []

    def late(snapshot):
        if not tries:  # the other one comes first, with one key that both have
            assert fast.append(frame(spark, (1, "f", "fast"), (2, "f", "fast"))) == 2
        tries.append(snapshot.version)
        return publish(snapshot)

    slow.publish = late
    assert slow.append(frame(spark, (2, "f", "slow"), (3, "f", "slow"))) == 1
    assert tries == [2, 3]
    assert rows_of(slow) == [(0, "f", "base"), (1, "f", "fast"), (2, "f", "fast"), (3, "f", "slow")]
    assert not slow.leftovers() and slow.current().rows == 4


def test_a_batch_counts_once(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.append(frame(spark, (1, "f", "a")), "ingest", 0) == 1
    assert table.append(frame(spark, (2, "f", "b")), "ingest", 0) == 0  # a repeat after a failure brings the same rows
    assert table.append(frame(spark, (1, "f", "c")), "ingest", 1) == 0
    assert table.append(frame(spark, (2, "f", "d")), "other", 0) == 1
    assert table.current().batches == {"ingest": 1, "other": 0} and len(rows_of(table)) == 2


@pytest.mark.parametrize("name", ["rf", "svm"])
def test_models_score_after_an_append(spark, tmp_path, name):
    assert sinks.upsert_append(spark, frame(spark, (1, "f", "a")), str(tmp_path / "plain")) == 1
    matrix = spark.range(400).selectExpr("id AS pr_id", "cast(id % 2 as int) AS label", "cast(id % 5 = 0 as int) AS is_test", "cast(id % 2 + id % 3 as double) AS x", "cast(id % 7 as double) AS y")
    model, test = fit_model(matrix, ["x", "y"], name)
    found = scored(model, test)
    assert found.count() == 80 and found.where("prediction = label").count() > 50


def test_a_repeated_batch_is_not_run(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.append(frame(spark, (1, "f", "a")), "load", 0) == 1
    broken = frame(spark, (2, "f", "b")).withColumn("status", F.raise_error(F.lit("run again")).cast("string"))
    assert table.append(broken, "load", 0) == 0


def test_appends_write_their_rows_once(spark, tmp_path, monkeypatch):
    """Neither kind of append leaves a second copy of its rows in the scratch folder."""
    monkeypatch.setattr("patchloom.session.scratch_dir", lambda *_: pytest.fail("a copy in the scratch folder"))
    table, path = SnapshotTable(spark, str(tmp_path / "t")), str(tmp_path / "plain")
    for part in ([(1, "f", "b"), (1, "f", "a"), (None, "f", "n")], [(1, "f", "c"), (None, "f", "o"), (2, None, "d")]):
        table.append(frame(spark, *part))
        sinks.upsert_append(spark, frame(spark, *part), path)
    plain = sorted((r.pr_id or 0, r.file or "", r.status) for r in sinks.read_keyed(spark, path).collect())
    assert plain == [(0, "f", "n"), (1, "f", "a"), (2, "", "d")]
    assert sorted((r.pr_id or 0, r.file or "", r.status) for r in table.rows().collect()) == plain


def test_landed_payloads_are_compressed(spark, tmp_path):
    from patchloom.workload.q_sources import land

    land(spark.range(5).selectExpr("id AS pr_id", "'s' AS sha", "'{}' AS payload"), str(tmp_path / "landed"))
    files = [p.name for p in (tmp_path / "landed").glob("part-*")]
    assert files and all(name.endswith(".json.gz") for name in files)
    assert spark.read.json(str(tmp_path / "landed")).count() == 5
