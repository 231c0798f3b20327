"""Operators against brute force on small frames."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchloom.operators import cumulative, predictors, quality, ranktests, reshape, sampling
from patchloom.operators.textjoin import join_lists, join_texts
from patchloom.plans import classify
from patchloom.plans.neighbours import knn_vote

rng = random.Random(7)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_order_bucket_is_monotone(spark):
    values = sorted([0.0, 1e-9, -1e-9, 1e300, -1e300] + [rng.gauss(0, 10 ** rng.randint(-5, 9)) for _ in range(500)])
    got = frame(spark, [(v,) for v in values], "v DOUBLE").select("v", cumulative.order_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in sorted(got.collect(), key=lambda r: r.v)]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("parts", [1, 7])
def test_describe_matches_pandas(spark, parts):
    rows = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 2, 5, 1000, rng.randint(0, 99)])) - 3) for _ in range(400)]
    rows += [("c", 4.0), (None, 1.0), ("a", None)]
    df = frame(spark, rows, "k STRING, v DOUBLE").repartition(parts)
    got = {r.k: r for r in cumulative.describe(df, ["k"], "v").collect()}
    want = pd.DataFrame(rows, columns=["k", "v"]).groupby("k")["v"].describe()
    assert set(got) == {"a", "b", "c"}
    for k, w in want.iterrows():
        r = got[k]
        assert r["count"] == w["count"]
        assert [r.mean, r.min, r.p25, r.p50, r.p75, r.max] == pytest.approx(
            [w["mean"], w["min"], w["25%"], w["50%"], w["75%"], w["max"]]
        )
        assert r["std"] is None if math.isnan(w["std"]) else r["std"] == pytest.approx(w["std"])


def midranks(values):
    order = pd.Series(values).rank(method="average")
    return order.to_numpy()


def test_mann_whitney_against_definition(spark):
    a = [rng.randint(0, 6) for _ in range(60)]
    b = [rng.randint(1, 8) for _ in range(45)]
    df = frame(spark, [("x", float(v)) for v in a] + [("y", float(v)) for v in b], "g STRING, v DOUBLE")
    r = ranktests.mann_whitney(df, "g", "v", "x", "y").first()
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    ranks = midranks(a + b)
    ties = sum(t**3 - t for t in np.unique(ranks, return_counts=True)[1])
    n1, n2, n = len(a), len(b), len(a) + len(b)
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert r.u_stat == u
    assert r.z_stat == pytest.approx(z)
    assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))
    other = ranktests.mann_whitney(df, "g", "v", "y", "x").first()
    assert r.u_stat + other.u_stat == n1 * n2
    with pytest.raises(ValueError):
        ranktests.mann_whitney(df, "nope", "v", "x", "y")


def test_kruskal_and_dunn(spark):
    groups = {"a": [1, 2, 2, 5, 9], "b": [2, 6, 7, 7, 8, 9], "c": [10, 11, 12, 2, 15, 16]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = frame(spark, rows, "g STRING, v DOUBLE")
    ranks = midranks([v for _, v in rows])
    n = len(rows)
    ties = sum(t**3 - t for t in np.unique(ranks, return_counts=True)[1])
    mean = {g: np.mean([r for r, (h, _) in zip(ranks, rows) if h == g]) for g in groups}
    h = 12 / (n * (n + 1)) * sum(len(groups[g]) * mean[g] ** 2 for g in groups) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    r = ranktests.kruskal(df, "g", "v", ["a", "b", "c"]).first()
    assert r.h_stat == pytest.approx(h)
    assert r.p_value == pytest.approx(math.exp(-h / 2))
    pairs = {(p.first, p.second): p for p in ranktests.dunn_holm(df, "g", "v", ["a", "b", "c"], alpha=None).collect()}
    base = n * (n + 1) / 12 - ties / (12 * (n - 1))
    raw = {}
    for i, j in (("a", "b"), ("a", "c"), ("b", "c")):
        z = (mean[i] - mean[j]) / math.sqrt(base * (1 / len(groups[i]) + 1 / len(groups[j])))
        assert pairs[(i, j)].z_stat == pytest.approx(z)
        raw[(i, j)] = math.erfc(abs(z) / math.sqrt(2))
    held = 0.0
    for step, (key, p) in enumerate(sorted(raw.items(), key=lambda x: x[1])):
        held = max(held, min(1.0, p * (3 - step)))
        assert pairs[key].p_holm == pytest.approx(held)
    # two and four groups use other degrees of freedom
    assert ranktests.kruskal(df, "g", "v", ["a", "b"]).first().p_value <= 1


def test_chi_square_tails(spark):
    one_row = spark.range(1)
    got = one_row.select(ranktests._chi2_tail(F.lit(3.84145882), 1).alias("a"), ranktests._chi2_tail(F.lit(7.81472790), 3).alias("b"), ranktests._chi2_tail(F.lit(9.48772904), 4).alias("c")).first()
    assert list(got) == pytest.approx([0.05, 0.05, 0.05], abs=1e-7)


def test_two_proportion_z(spark):
    cols = [F.lit(v) for v in (332, 8089, 538, 7338)]
    z = spark.range(1).select(ranktests.two_proportions(*cols).alias("z")).first().z
    p1, p2, p = 332 / 8089, 538 / 7338, 870 / 15427
    assert z == pytest.approx((p1 - p2) / math.sqrt(p * (1 - p) * (1 / 8089 + 1 / 7338)))


@pytest.mark.parametrize("parts", [1, 5])
def test_fraction_sample_size_and_repeatability(spark, parts):
    df = spark.range(1001).withColumn("g", F.when(F.col("id") < 30, "s").otherwise("l")).repartition(parts)
    got = sampling.sample_fraction(df, 0.05, ["id"], ["g"]).collect()
    assert sum(r.g == "s" for r in got) == 2  # 1.5 rounds half to even
    assert sum(r.g == "l" for r in got) == 49
    again = sampling.sample_fraction(df.repartition(3), 0.05, ["id"], ["g"]).collect()
    assert {r.id for r in got} == {r.id for r in again}
    assert sampling.sample_n(df, 10, ["id"]).count() == 10


def test_joined_texts_split_but_lose_nothing(spark):
    rows = [("hot", f"k{i:03d}", f"text{i}") for i in range(200)] + [("cold", "k1", "a"), ("cold", "k0", "b"), ("cold", "k2", None)]
    df = frame(spark, rows, "g STRING, k STRING, t STRING")
    whole = {(r.g, r.part): r.t for r in join_texts(df, ["g"], {"t": "t"}, ["k"], " ").collect()}
    assert whole[("cold", 0)] == "b a"
    assert whole[("hot", 0)] == " ".join(f"text{i}" for i in range(200))
    parts = join_texts(df, ["g"], {"t": "t"}, ["k"], " ", max_chars=100).collect()
    hot = [r for r in parts if r.g == "hot"]
    assert len(hot) > 5
    assert sorted(w for r in hot for w in r.t.split()) == sorted(f"text{i}" for i in range(200))
    assert [r.t for r in parts if r.g == "cold"] == ["b a"]


def test_joined_lists_keep_repeats_and_order(spark):
    df = frame(spark, [(1, 2, ["b", "a"]), (1, 1, ["a"]), (2, 1, [])], "g INT, k INT, xs ARRAY<STRING>")
    got = {r.g: r.xs for r in join_lists(df, ["g"], ["xs"], ["k"]).collect()}
    assert got == {1: ["a", "b", "a"], 2: []}


def test_quality_checks(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (2, None)], "k INT, v STRING")
    assert quality.repeated_keys(df, ["k"]).collect()[0].asDict() == {"k": 1, "rows": 2}
    for call in (
        lambda: quality.assert_unique(df, ["k"]),
        lambda: quality.assert_no_nulls(df, ["k", "v"]),
        lambda: quality.assert_bound(df, "k", 2),
        lambda: quality.assert_row_preserving(df, ["k"]),
    ):
        with pytest.raises(quality.DataCheckError):
            call()
    quality.assert_unique(df, ["k", "v"])
    quality.assert_bound(df, "k", 3)
    with pytest.raises(ValueError):
        quality.require_columns(df, ["nope"])


def test_reshape(spark):
    df = frame(spark, [(["a", "a", "b"], ["b"])], "x ARRAY<STRING>, y ARRAY<STRING>")
    row = df.select(reshape.without(F.col("x"), F.col("y")).alias("w"), reshape.overlaps(F.col("x"), F.col("y")).alias("o")).first()
    assert (row.w, row.o) == (["a", "a"], True)
    hot = reshape.one_hot(frame(spark, [(1, "b"), (2, "a"), (3, None)], "k INT, c STRING"), "c", ["a", "b"])
    assert hot.columns == ["k", "c_a", "c_b"]
    many = spark.range(1300).select(F.col("id").cast("string").alias("c")).union(spark.sql("SELECT CAST(null AS STRING)"))
    vectors = [r.c_vector for r in reshape.one_hot_vector(many, "c").collect()]
    assert {v.size for v in vectors} == {1300} and sorted(v.numNonzeros() for v in vectors) == [0] + [1] * 1300


def test_judge_retries_skips_and_checks_range(spark):
    class Flaky:
        """Fails on its first call, and always for texts with 'bad'."""

        def __init__(self):
            self.calls = 0

        def predict(self, pairs):
            self.calls += 1
            if self.calls == 1 or any("bad" in m for m, _ in pairs):
                raise RuntimeError("no answer")
            return [(9, 0) if "out" in m else (3, 2) for m, _ in pairs]

    rows = [("ok", "p"), ("bad", "p"), ("out", "p"), (" ", "p"), ("ok", None)]
    df = frame(spark, rows, "message STRING, patch STRING").coalesce(1)
    got = predictors.judge(df, factory=Flaky, pause=0.0).collect()
    assert [(r.what_score, r.why_score) for r in got] == [(3, 2), (None, None), (None, None), (None, None), (None, None)]


def test_failed_batch_is_null_and_order_is_kept(spark):
    class Broken:
        def predict(self, texts):
            if any("x" in t for t in texts):
                raise RuntimeError
            return [t.upper() for t in texts]

    df = frame(spark, [(i, t) for i, t in enumerate(["a", "x", " ", "b", None, "c"])], "i INT, t STRING").coalesce(1)
    got = predictors.generate(df, "t", "o", Broken, batch_size=2).orderBy("i").collect()
    assert [r.o for r in got] == [None, None, None, "B", None, "C"]
    with pytest.raises(ValueError):
        predictors.generate(df, "missing", "o", Broken)


def test_pair_scores_keep_rows(spark):
    df = frame(spark, [("a b", "b c"), ("a b", "b c"), ("a", None)], "c STRING, r STRING")
    got = predictors.score_distinct_pairs(df, "c", "r").collect()
    assert len(got) == 3
    assert sorted((r.pair_rows or 0) for r in got) == [0, 2, 2]
    direct = predictors.score_pairs(df, "c", "r").collect()
    assert [r.overlap_f1 for r in direct] == [0.5, 0.5, None]


def brute_knn(train, test, k):
    out = {}
    for key, x in test:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), i, lab) for i, y, lab in train)[:k]
        out[key] = sum(lab for _, _, lab in near) / len(near)
    return out


def test_neighbour_vote_is_exact(spark):
    train = [(i, (float(rng.choice([0, 0, 0, rng.randint(0, 500)])), float(rng.randint(0, 9))), rng.randint(0, 1)) for i in range(300)]
    test = [(1000 + i, (float(rng.randint(-20, 900)), float(rng.randint(0, 9)))) for i in range(40)]
    tr = frame(spark, [(i, x[0], x[1], y) for i, x, y in train], "pr_id LONG, a DOUBLE, b DOUBLE, label INT")
    te = frame(spark, [(i, x[0], x[1], 0) for i, x in test], "pr_id LONG, a DOUBLE, b DOUBLE, label INT")
    for size in (8, 256):
        got = {r.pr_id: r.score for r in knn_vote(tr, te, ["a", "b"], block_rows=size).collect()}
        assert got == pytest.approx(brute_knn(train, test, 5))
    bounded = knn_vote(tr, te, ["a", "b"], max_reference=20, batch_rows=7).collect()
    assert len(bounded) == 40 and {round(r.score * 5) for r in bounded} <= {0, 1, 2, 3, 4, 5}
    far = te.withColumn("a", F.lit(1e12))
    assert knn_vote(tr.withColumn("a", F.lit(0.0)), far, ["a", "b"]).count() == 40


def test_auc_and_roc(spark):
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = frame(spark, rows, "label INT, score DOUBLE")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert classify.auc(df).first().auc == pytest.approx(want)
    assert classify.auc(df.where("label = 1")).first().auc is None
    points = sorted(classify.roc_points(df).collect(), key=lambda r: -r.threshold)
    assert (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    area = sum((b.fpr - a[0]) * (b.tpr + a[1]) / 2 for a, b in zip([(0.0, 0.0)] + [(p.fpr, p.tpr) for p in points], points))
    assert area == pytest.approx(want)


def test_dunn_with_an_absent_label(spark):
    from patchloom.operators.ranktests import dunn_holm

    df = frame(spark, [("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 5.0), ("one", "a", 1.0)], "k STRING, g STRING, v DOUBLE")
    got = {(r.k, r.first, r.second): r.z_stat for r in dunn_holm(df, "g", "v", ["a", "b", "c"], ["k"], alpha=None).collect()}
    assert got["k", "a", "b"] is not None and got["k", "a", "c"] is None and got["one", "a", "b"] is None


def test_column_scores(spark):
    from patchloom.functions import text

    df = frame(spark, [("One two. Three four five! Six seven eight\nend",), (" \n ",), ("",), (None,)], "t STRING")
    assert [r.s for r in df.select(text.key_sentence(F.col("t")).alias("s")).collect()] == ["Three four five", None, None, None]
    coded = [r.e for r in predictors.add_embedding(df, "t", "e", size=700).collect()]
    assert len(coded[0]) == 700 and sum(coded[0]) == 9 and coded[1:] == [None, None, None]
    scores = [tuple(r) for r in df.select(*text.message_rules(F.col("t"), F.lit("two five end"))).collect()]
    assert scores == [(4, 1), (None, None), (None, None), (None, None)]


def test_fitted_language_on_held_out_documents(spark):
    from patchloom.plans import language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    train, rest = docs.where("doc_id % 4 > 0"), docs.where("doc_id % 4 = 0")
    told = language.add_fitted_language(language.fit_language(train, "text"), rest, "text")
    assert told.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.95
    blank = frame(spark, [(1, None, None), (2, "de", " ")], "doc_id INT, lang STRING, text STRING")
    got = language.add_fitted_language(language.fit_language(train, "text"), blank, "text").collect()
    assert [(r.language, r.confidence) for r in got] == [(None, None), (None, None)]


def test_measures_of_a_pull_request_with_repeated_and_missing_names(spark):
    from patchloom.plans.change_size import per_pr

    rows = [(1, "a/b/f.py", "s", 1, 1, None), (1, "a/b/f.py", "t", 2, 2, 0), (1, None, "s", 4, None, 0), (1, "c/b/g.py", None, 8, 8, 0), (None, "x", "s", 1, 1, 1)]
    df = frame(spark, rows, "pr_id LONG, filename STRING, sha STRING, changes LONG, additions LONG, deletions LONG")
    got = per_pr(df, ["pr_id"]).collect()
    assert [tuple(r) for r in got] == [(1, 15, 11, 0, 2, 2, 1, 2)]


def test_exact_distribution_of_u():
    from itertools import combinations

    from patchloom.operators.ranktests import u_counts

    for k in range(1, 9):
        for m in range(k, 9):
            want = [0] * (k * m + 1)
            for taken in combinations(range(k + m), k):
                want[sum(taken) - k * (k - 1) // 2] += 1
            assert u_counts(k, m).tolist() == want
    assert int(u_counts(8, 40_000).sum()) == math.comb(40_008, 8)


def test_small_groups_without_ties_are_judged_exactly(spark):
    rows = [("k", "a", float(x)) for x in (1, 2, 3)] + [("k", "b", float(x)) for x in (4, 5, 6)]
    rows += [("t", g, v) for _, g, v in rows] + [("t", "a", 6.0)]
    got = {r.key: r for r in ranktests.mann_whitney(spark.createDataFrame(rows, "key string, g string, v double"), "g", "v", "a", "b", ["key"]).collect()}
    assert got["k"].p_value == pytest.approx(0.1) and not got["k"].significant
    assert got["t"].p_value != pytest.approx(2 * 1 / 35) and got["t"].p_value == pytest.approx(math.erfc(got["t"].z_stat / 2**0.5))


def test_top_of_the_hashes_leaves_few_rows_to_rank(spark):
    rows = spark.range(20_000).withColumn("g", F.col("id") % 3)
    cut = sampling.lowest_hashes(rows, 500, ["id"])
    assert 500 <= cut.count() < 520
    ranked = rows.withColumn("h", sampling.hash_order(["id"], 42)).orderBy("h").limit(500)
    assert {r.id for r in sampling.sample_n(rows, 500, ["id"]).collect()} == {r.id for r in ranked.collect()}
    same = rows.withColumn("k", F.lit("x"))
    assert sampling.sample_n(same, 7, ["k"]).count() == 7
    assert sampling.lowest_hashes(rows, 30_000, ["id"]).count() == 20_000
