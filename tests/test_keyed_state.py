"""The ingest that keeps the seen keys as state of its query."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patchloom.streaming.ingest import ingest_keyed

SCHEMA = "id LONG, file STRING, note STRING"
KEYS = ("id", "file")


def land(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/landed", ignoreNullFields=False)


def run(spark, folder, transform=lambda rows: rows):
    (folder / "landed").mkdir(exist_ok=True)
    source = spark.readStream.schema(SCHEMA).json(f"{folder}/landed")
    return ingest_keyed(source, f"{folder}/table", f"{folder}/checkpoint", transform, KEYS, state_partitions=2)


def table(spark, folder):
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/table").fillna("-").fillna(-1).collect())


def test_seen_keys_survive_a_restart(spark, tmp_path):
    land(spark, tmp_path, (1, "a", "first"), (2, "a", "first"), (2, "a", "first"), (None, "a", "first"))
    assert run(spark, tmp_path) == 3
    land(spark, tmp_path, (1, "a", "second"), (1, "b", "second"), (None, "a", "second"), (None, None, "second"))
    assert run(spark, tmp_path) == 5
    expected = [(-1, "-", "second"), (-1, "a", "first"), (1, "a", "first"), (1, "b", "second"), (2, "a", "first")]
    assert table(spark, tmp_path) == expected
    run(spark, tmp_path)
    assert table(spark, tmp_path) == expected


def test_a_failed_batch_is_repeated_whole(spark, tmp_path):
    land(spark, tmp_path, (1, "a", "x"))
    run(spark, tmp_path)
    land(spark, tmp_path, *[(i, "a", "y") for i in range(20)])
    stop = F.when(F.col("id") == 13, F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.col("note"))
    with pytest.raises(Exception, match="stopped"):
        run(spark, tmp_path, lambda rows: rows.withColumn("note", stop))
    assert table(spark, tmp_path) == [(1, "a", "x")]
    assert run(spark, tmp_path) == 20
    assert table(spark, tmp_path) == [(i, "a", "x" if i == 1 else "y") for i in range(20)]


def test_the_table_is_not_read(spark, tmp_path):
    """A run adds its rows though the data files of the table are gone; session settings are as before."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    land(spark, tmp_path, (1, "a", "x"), (2, "a", "x"))
    run(spark, tmp_path)
    for part in (tmp_path / "table").glob("part-*"):
        part.rename(tmp_path / part.name)
    land(spark, tmp_path, (2, "a", "z"), (3, "a", "z"))
    assert run(spark, tmp_path) == 3
    new = [str(p) for p in (tmp_path / "table").glob("part-*")]
    assert [tuple(r) for r in spark.read.parquet(*new).collect()] == [(3, "a", "z")]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")


def test_nothing_landed(spark, tmp_path):
    assert run(spark, tmp_path) is None


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def left_of(spark, before):
    """Files of later shuffles that are still there after some seconds; they are removed in the background."""
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_batches_and_landed_lots_leave_no_shuffle_files(spark, tmp_path):
    from patchloom.workload.q_sources import land as land_lot

    land(spark, tmp_path, *[(i, "a", "x") for i in range(50)])
    before = shuffle_files(spark)
    assert run(spark, tmp_path) == 50
    assert not left_of(spark, before)
    land_lot(spark.range(100).repartition(3), f"{tmp_path}/lot")
    assert not left_of(spark, before)
    assert spark.read.json(f"{tmp_path}/lot").count() == 100


def test_parts_joined_last_give_the_same_rows(spark, tmp_path):
    """Texts of parts are not shuffled beside the file rows; null and repeated keys give what they gave."""
    from patchloom.workload.views import TABLES, Views

    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    items = [(o, p, 1, n, 5.0 * n, 10.0, 0.07, 0.1, "ANR"[n % 3], "F", None) for n, (o, p) in enumerate([(1, 1), (1, 2), (2, 2), (None, 1), (3, None), (9, 1), (1, 1)])]
    orders = [(1, 3, "F", 1.0, None, "3-MEDIUM"), (2, None, "O", 1.0, None, None), (2, 13, "O", 1.0, None, "1-URGENT"), (None, 1, "F", 1.0, None, "5-LOW"), (3, 4, "F", 1.0, None, "2-HIGH")]
    parts = [(1, "a b", "B#1", "T", 1, 1.0), (2, None, "B#2", "U", 1, 1.0), (2, "c d", None, "U", 1, 1.0), (None, "e", "B", "V", 1, 1.0)]
    for name, rows in (("lineitem", items), ("orders", orders), ("part", parts)):
        other.createDataFrame(rows, TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    views = Views(other, str(tmp_path))
    narrow = views.all_details(narrow=True)
    assert Counter(map(tuple, narrow.collect())) == Counter(map(tuple, views.all_details().collect()))
    assert narrow.count() > 5
    plan = narrow._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join Inner" in line]
    assert "p_partkey" in plan[joins[0]] and "o_orderkey" in plan[joins[1]]
