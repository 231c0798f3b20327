"""Exact attributions against all subsets of features."""

from __future__ import annotations

import math
from itertools import combinations

import pytest
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patchloom.plans import attribution

NAMES = list("abcde")


@pytest.fixture(scope="module")
def rows(spark):
    h = [F.pmod(F.xxhash64("id", F.lit(n)), F.lit(23)).cast("double").alias(n) for n in NAMES]
    wanted = ((F.col("a") > 11) == (F.col("b") > 7)) | (F.col("c") > 19)
    return spark.range(300).select("id", *h).withColumn("label", wanted.cast("int")).persist()


def fitted(rows, estimator):
    return estimator.fit(VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows))


def subsets(paths: list, row) -> list[float]:
    """The definition: each subset's score, leaf by leaf, and the weighted gains."""

    def score(known):
        total = 0.0
        for value, steps in paths:
            part = value
            for feature, low, high, share in steps:
                part *= float(low < row[NAMES[feature]] <= high) if feature in known else share
            total += part
        return total

    n, out = len(NAMES), []
    every = {frozenset(c): score(c) for k in range(n + 1) for c in combinations(range(n), k)}
    for i in range(n):
        out.append(sum(
            math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (every[s | {i}] - v)
            for s, v in every.items() if i not in s
        ))
    return out


@pytest.mark.parametrize("estimator", [RandomForestClassifier(numTrees=4, maxDepth=5, seed=3), GBTClassifier(maxIter=3, maxDepth=4, seed=3)])
def test_equals_all_subsets_and_the_model(spark, rows, estimator):
    model = fitted(rows, estimator)
    paths = attribution.forest_paths(spark, model)
    some = rows.where("id % 20 = 0")
    got = {(r.id, r.feature): r for r in attribution.tree_attributions(paths, some, NAMES, "id").collect()}
    assert len(got) == 15 * 5
    table = [
        (leaf.value.iloc[0], list(leaf[["feature", "low", "high", "share"]].itertuples(index=False, name=None)))
        for _, leaf in paths.toPandas().groupby(["tree", "leaf"])
    ]
    scored = model.transform(VectorAssembler(inputCols=NAMES, outputCol="features").transform(some)).collect()
    for r in scored:
        own = [got[r.id, n] for n in NAMES]
        assert [x.attribution for x in own] == pytest.approx(subsets(table, r), abs=1e-12)
        assert [x.feature_value for x in own] == [r[n] for n in NAMES]
        probability = own[0].score if isinstance(estimator, RandomForestClassifier) else 1 / (1 + math.exp(-2 * own[0].score))
        assert probability == pytest.approx(r.probability[1], abs=1e-12)
        assert sum(x.attribution for x in own) == pytest.approx(own[0].score - own[0].base_score, abs=1e-12)


def test_shares_follow_the_training_rows(spark, rows):
    paths = attribution.forest_paths(spark, fitted(rows, RandomForestClassifier(numTrees=5, maxDepth=3, seed=1))).toPandas()
    for _, tree in paths.groupby("tree"):
        assert sum(leaf.share.prod() for _, leaf in tree.groupby("leaf")) == pytest.approx(1)
        assert not tree.duplicated(["leaf", "feature"]).any()


HAND = [(0, 1, 1.0, 0, -math.inf, 2.0, 0.5), (0, 2, 3.0, 0, 2.0, math.inf, 0.5), (1, 0, 7.0, None, None, None, None)]


def test_nulls_ties_repeats_empty_and_lone_leaf(spark):
    paths = spark.createDataFrame(HAND, attribution.PATHS)
    schema = "pr_id LONG, x DOUBLE, `own` INT, score STRING"
    data = spark.createDataFrame([(1, 2.0, 0, "s"), (1, 2.0, 0, "s"), (2, None, None, None), (None, math.inf, 1, "t")], schema)
    got = sorted(((r.pr_id or 0, r.feature, r.attribution, r.score, r.base_score) for r in attribution.tree_attributions(paths, data, ["x", "own"]).collect()))
    left, right = (-1.0, 8.0, 9.0), (1.0, 10.0, 9.0)
    want = [(0, "x", *right), (1, "x", *left), (1, "x", *left), (2, "x", *right)]
    assert [g for g in got if g[1] == "x"] == want
    assert all(g[2] == 0 for g in got if g[1] == "own") and len(got) == 8
    assert attribution.tree_attributions(paths, data.limit(0), ["x", "own"]).count() == 0
    assert attribution.tree_attributions(paths.limit(0), data, ["x"]).agg(F.sum("score")).first()[0] == 0


def test_model_without_trees_is_refused(spark, rows):
    with pytest.raises(ValueError):
        attribution.forest_paths(spark, fitted(rows, LinearSVC(maxIter=1)))


def test_cutoff_tables(spark):
    data = [(i, "f", float(i), i / 10, 0.0, 0.0) for i in range(50)] + [(i, "g", float(i), 0.0, 0.0, 0.0) for i in range(50)]
    table = spark.createDataFrame(data, "pr_id LONG, feature STRING, feature_value DOUBLE, attribution DOUBLE, score DOUBLE, base_score DOUBLE")
    got = attribution.cutoff_tables(table, {"f": (20, 13), "g": (None, 7)}, n=40).toPandas()
    f, g = got[got.feature == "f"], got[got.feature == "g"]
    assert len(g) == 40 and f.feature_value.max() < 20 and set(f.pr_id) == {i for i in g.pr_id if i < 20}
    assert (f.beyond_mark == (f.feature_value > 13)).all() and (g.beyond_mark == (g.feature_value > 7)).all()
