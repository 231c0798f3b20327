"""One key or value holding a third of all rows, and the scratch folder."""

from __future__ import annotations

import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from patchloom.operators import cumulative
from patchloom.operators.textjoin import join_lists, join_texts
from patchloom.plans import churn
from patchloom.session import scratch_dir
from patchloom.sources.sinks import first_per_key


def test_hot_value_and_hot_key(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        F.when(F.col("id") % 3 == 1, F.lit(7.0)).otherwise(F.col("id") % 101).cast("double").alias("v"),
        "id",
    )
    want = hot.toPandas().groupby("k")["v"].quantile(0.5)
    got = {r.k: r.m for r in cumulative.percentiles(hot, ["k"], "v", {"m": 0.5}).collect()}
    assert got == pytest.approx(want.to_dict())
    first = {r.k: r.id for r in first_per_key(hot, ["k"], ["id"]).collect()}
    assert first == hot.toPandas().groupby("k")["id"].min().to_dict()


def test_values_close_together_fall_in_many_even_buckets(spark):
    close = spark.range(20000).select(F.lit("m").alias("k"), (F.lit(1.7e15) + F.col("id")).cast("double").alias("v"))
    counts = cumulative.value_counts(close, ["k"], "v")
    cuts = cumulative.cut_points(counts, ["k"], "value").first()._cuts
    assert len(cuts) == cumulative.BUCKETS - 1
    steps = [b - a for a, b in zip(cuts, cuts[1:])]
    assert max(steps) <= 2 * 20000 / cumulative.BUCKETS
    ranked = cumulative.running_before(counts, ["k"], ["n"])
    assert ranked.where("before_n <> value - 1.7e15 OR total_n <> 20000").count() == 0
    assert cumulative.percentiles(close, ["k"], "v", {"m": 0.5}).first().m == 1.7e15 + 9999.5


def test_joined_texts_are_contiguous_chunks(spark):
    rows = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.lpad(F.col("id").cast("string"), 4, "0").alias("o"),
        F.concat(F.lit("t"), F.col("id")).alias("t"),
    )
    want = rows.toPandas().sort_values("o").groupby("k")["t"].agg(" ".join).to_dict()
    for limit in (1, 20, 10**6):
        parts = sorted(join_texts(rows.repartition(7), ["k"], {"t": "t"}, ["o"], " ", max_chars=limit).collect(), key=lambda r: (r.k, r.part))
        got: dict = {}
        for r in parts:
            got.setdefault(r.k, []).append(r.t)
            assert r.part > 0 or len(got[r.k]) == 1
            assert len(r.t) <= limit + 5
        assert {k: " ".join(v) for k, v in got.items()} == want
    assert len(parts) == len(want)
    weighed = join_texts(rows, ["k"], {"t": "t"}, ["o"], " ", max_chars=100, weight=F.lit(50).cast("long"))
    assert weighed.agg(F.max("rows")).first()[0] == 2


def exchanges(df):
    return re.findall(r"(?m)^[ :+-]*(?:Reused)?Exchange (\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_texts_of_keys_below_the_limit_are_shuffled_once(spark, monkeypatch):
    """Only keys that may be cut are ranged; repeated rows are dropped where the texts of a key are joined."""
    from patchloom.operators import textjoin

    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.concat(F.lit("t"), F.col("id") % 300).alias("t")
    )
    plain, ranged = textjoin._chunked, []

    def chunked(df, *more):
        ranged.append(df.select("k").distinct().count())
        return plain(df, *more)

    monkeypatch.setattr(textjoin, "_chunked", chunked)
    whole = join_texts(rows, ["k"], {"t": "t"}, ["t"], " ", distinct=True)
    assert exchanges(whole) == ["hashpartitioning"] and not ranged
    want = {k: " ".join(sorted(set(t))) for k, t in rows.toPandas().groupby("k")["t"]}
    assert {r.k: r.t for r in whole.collect()} == want
    assert {r.k: r.rows for r in whole.collect()} == {k: len(t.split()) for k, t in want.items()}
    cut = join_texts(rows.unionByName(rows), ["k"], {"t": "t"}, ["t"], " ", max_chars=400, distinct=True).collect()
    assert ranged == [1] and max(r.part for r in cut) > 0
    got = Counter()
    for r in sorted(cut, key=lambda r: (r.k, r.part)):
        got[r.k] = f"{got[r.k]} {r.t}" if got[r.k] else r.t
    assert got == want


def test_joined_lists_keep_null_keys_and_order(spark):
    rows = spark.createDataFrame([(None, 2, ["c"]), (None, 1, ["a", "b"]), ("x", 1, []), ("x", 2, None), ("x", 3, ["d", "d"])], "k STRING, o INT, xs ARRAY<STRING>")
    got = {r.k: r.xs for r in join_lists(rows.where("xs IS NOT NULL"), ["k"], ["xs"], ["o"]).collect()}
    assert got == {None: ["a", "b", "c"], "x": ["d", "d"]}


def test_plan_of_percentiles_has_no_whole_table_window(spark):
    df = spark.range(100).select(F.lit("m").alias("k"), F.rand(1).alias("v"))
    plan = cumulative.percentiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    # a window over values is split by bucket; one over a key alone sums bucket totals (_t_n)
    assert all("_t_n" in line or "_bucket" in line for line in windows)
    assert any("_bucket" in line and "value" in line for line in windows)


def test_common_name_costs_one_row_per_task(spark):
    events = spark.range(900).select(
        F.col("id").alias("pr_id"),
        F.lit(1).alias("is_agent"),
        F.when(F.col("id") % 3 == 0, "main").otherwise(F.concat(F.lit("f"), "id")).alias("name"),
        F.lit(1).alias("added"),
        F.lit(0).alias("removed"),
    )
    repos = spark.range(900).select(
        F.col("id").alias("pr_id"), F.lit("r").alias("repo_id"), F.to_timestamp(F.lit("2025-01-01")).alias("merged_at_dt")
    )
    life = churn.lifetimes(events, repos)
    assert life.where("func_class = 'main'").first().added_pr_id == 0
    assert life.count() == 601


def test_scratch_folder_follows_the_session(spark, tmp_path):
    made = []
    context = SimpleNamespace(master="local[2]", getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    assert scratch_dir(unset, "x").startswith(made[0])
    shared = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs://shared/cp/"), sparkContext=context)
    assert scratch_dir(shared, "x").startswith("hdfs://shared/cp/patchloom/x-")
    assert len(made) == 1
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        context.master = master
        with pytest.raises(ValueError):
            scratch_dir(unset, "x")


def test_what_a_task_takes_is_bounded(spark):
    """Splits of files and joined shuffle partitions stay small in a session brought along; smaller settings stay."""
    from patchloom.session import INITIAL_KEY, prepare

    files, joined = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other = spark.newSession()
    other.conf.set(files, "128MB")
    other.conf.set(joined, "1m")
    prepare(other)
    assert (other.conf.get(files), other.conf.get(joined)) == (str(16 << 20), "1m")
    assert int(other.conf.get(INITIAL_KEY)) >= 400


def test_measures_are_counted_and_joined_in_different_stages(spark):
    """A step that counts or sorts takes a page of memory per task: rows that lie by pull request must not pass all steps in one task."""
    from patchloom.plans.features import build_features

    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    other.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    base = other.createDataFrame([(1, "a b", "x"), (1, "c", None), (2, None, "y z"), (None, "d", "")], "pr_id LONG, pr_title STRING, pr_body STRING")
    types = other.createDataFrame([(1, "fix")], "pr_id LONG, task_type STRING")
    related = other.createDataFrame([(1, 7), (1, None), (3, 8), (None, 9)], "pr_id LONG, issue_id LONG")
    commits = other.createDataFrame([(1, "s", "m n"), (2, "t", None), (None, "u", "o")], "pr_id LONG, sha STRING, message STRING")
    files = [(1, "p/q.py", "added", 3, 1, 4), (1, "p/q.py", "modified", 2, 0, 2), (1, "r.py", "removed", 0, 5, 5), (None, "v/w.py", "added", 1, 1, 2)]
    details = other.createDataFrame(files, "pr_id LONG, filename STRING, status STRING, additions LONG, deletions LONG, changes LONG").repartition("pr_id")
    out = build_features(base, types, related, commits, details)
    path = []
    for lead, name in re.findall(r"^([ :]*[+:]- )(\w+)", out._jdf.queryExecution().executedPlan().toString(), re.M):
        path = [p for p in path if p[0] < len(lead)] + [(len(lead), name)]
        above = [p[1] for p in reversed(path)]
        stage = above[: above.index("Exchange")] if "Exchange" in above else above
        assert not (name.endswith("Aggregate") and "SortMergeJoin" in stage), stage
    names = ("pr_id", "pr_title_length", "task_type", "number_of_related_issues", "number_of_commits", "number_of_files_changed", "total_changes")
    full = ("fix", 1, 1, 2, 11)
    want = [(1, 2, *full), (1, 1, *full), (2, None, None, None, 1, None, None), (None, 1, None, None, None, None, None)]
    assert Counter(tuple(r) for r in out.select(*names).collect()) == Counter(want)


def test_walks_are_dealt_before_their_steps_become_rows(spark):
    """Rows of one small file are expanded in many tasks, and the steps of a walk are put together where they were made."""
    from patchloom.plans import classify

    rows = spark.range(40).select(F.col("id").alias("pr_id"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    rows = rows.withColumn("is_test", (F.col("pr_id") % 4 == 0).cast("int")).coalesce(1)
    model, test = classify.fit_model(rows, ["x", "y"], "rf")
    out = classify.attributions(model, test, rows.where("is_test = 0"), ["x", "y"], permutations=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("Exchange hashpartitioning") > plan.rfind("partial_collect_list")
    sums = out.groupBy("pr_id").agg(F.count("*").alias("n"), (F.sum("attribution") - F.max("score") + F.max("base_score")).alias("gap")).collect()
    assert len(sums) == 10 and all(r.n == 2 and abs(r.gap) < 1e-9 for r in sums)


def test_rows_are_dealt_before_they_vote(spark):
    """Rows of one small file meet the reference in many tasks; null and repeated keys keep their rows."""
    from patchloom.plans.neighbours import knn_vote

    rows = spark.range(60).select(F.when(F.col("id") % 20 > 1, F.col("id") % 40).alias("pr_id"), (F.col("id") % 7).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    voted = knn_vote(spark.range(70).select(F.col("id").alias("pr_id"), (F.col("id") % 7).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label")), rows.coalesce(1), ["x"])
    assert len(voted.select(F.spark_partition_id().alias("p")).distinct().collect()) == 4
    want = rows.select("pr_id", "label", F.col("label").cast("double"), "label").collect()
    assert Counter(map(tuple, voted.collect())) == Counter(map(tuple, want))


def test_rows_of_a_sample_are_found_without_a_shuffle_of_all(spark, monkeypatch):
    """Rows meet the cuts per hash prefix where they lie, and whole texts of a corpus are shuffled by their key alone."""
    from patchloom.operators import sampling, textjoin
    from patchloom.plans import textpairs

    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ids = other.range(400).select(F.concat(F.lit("s"), F.col("id") % 150).alias("sha"), F.concat(F.lit("p"), F.col("id") % 200).alias("patch"))
    picked = sampling.sample_fraction(ids, 0.05, ["sha", "patch"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert picked.count() == 20

    written, plain = [], textjoin.materialize
    monkeypatch.setattr(textjoin, "materialize", lambda df, label: written.append(df) or plain(df, label))
    corpus = other.createDataFrame([("h", "m", "+x y"), ("h", "n", "+x y"), ("h", "m", "+a"), (None, "m", "+z"), ("i", "m", None)], "hash STRING, message STRING, diff STRING")
    out = textpairs.patches_for_generation(ids, ids.where("false"), corpus)
    kept = [r for r in out.collect() if r.is_agent == 2]
    assert {(r.sha, r.part, r.patch) for r in kept} == {("h", 0, "+a\n+x y"), ("i", 0, None)} and len(kept) == 2
    assert sum(len(r.patch.split("\n")) for r in out.where("is_agent = 1").collect()) == round(0.05 * ids.distinct().count())
    assert len(written) == 1
    assert not re.search(r"Exchange hashpartitioning\(hash#", written[0]._jdf.queryExecution().executedPlan().toString())


def test_lists_of_keys_below_the_limit_are_shuffled_once(spark, tmp_path):
    """Items travel once, not also as the columns they are ordered by; their order is that of file name, then status."""
    from patchloom.workload import all_queries
    from patchloom.workload.views import TABLES, Views

    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 20).alias("k"), "id", F.array(F.struct((F.col("id") % 7).alias("a"), "id")).alias("xs"))
    lists = join_lists(rows, ["k"], ["xs"], ["id"])
    assert exchanges(lists) == ["hashpartitioning"]
    cut = join_lists(rows, ["k"], ["xs"], ["id"], max_items=30)
    assert cut.where("k IS NULL").count() > 1 and cut.where("k IS NOT NULL AND part > 0").count() == 0
    whole = {r.k: [x.id for x in r.xs] for r in lists.collect()}
    assert {k: whole[k] for k in (None, 4)} == {None: list(range(0, 300, 3)), 4: [i for i in range(4, 300, 20) if i % 3]}

    names = ["a", "a b", "a!", "a,b", "", None, "B"]
    items = [(5, p, 1, 1, 5.0, 10.0, 0.07, 0.1, flag, "F", None) for p in range(len(names)) for flag in "RAN"]
    for name, made in (("lineitem", items), ("orders", [(5, 3, "F", 1.0, None, "5-LOW")]), ("part", [(p, n, "B#1", "T", 1, 1.0) for p, n in enumerate(names)])):
        spark.createDataFrame(made, TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = all_queries()["a20_file_lists_per_pr"](spark, str(tmp_path)).collect()
    kept = [(r.filename, r.status) for r in Views(spark, str(tmp_path)).all_details().collect()]
    ordered = sorted(kept, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.pr_id, r.part, r["items"]) for r in got] == [(5, 0, ";".join(",".join(x for x in r if x is not None) for r in ordered))]
