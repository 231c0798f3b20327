"""Exact nearest neighbours against all distances."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.plans import exact_neighbours
from patchloom.plans.exact_neighbours import exact_vote
from patchloom.plans.neighbours import knn_vote

SCHEMA = "pr_id LONG, a DOUBLE, b DOUBLE, label INT"


def rows_of(seed, n, first, spread):
    """Points on a grid (many ties), a third of them equal."""
    draw = np.random.default_rng(seed)
    points = draw.integers(-spread, spread, (n, 2)).astype(float)
    points[: n // 3] = 1.0
    return [(first + i, float(x), float(y), int(draw.integers(0, 2))) for i, (x, y) in enumerate(points)]


def brute(train, test, k):
    known = sorted(r for r in train)
    out = {}
    for key, a, b, _ in test:
        near = sorted(known, key=lambda r: ((a - r[1]) ** 2 + (b - r[2]) ** 2, r[0]))[:k]
        out[key] = sum(r[3] for r in near) / len(near)
    return out


@pytest.mark.parametrize("k,sizes", [(5, {}), (1, {"pivots": 1, "rings": 1}), (7, {"pivots": 9, "rings": 4, "part_rows": 3}), (500, {"pivots": 4})])
def test_equals_all_distances(spark, k, sizes):
    train, test = rows_of(1, 240, 0, 12), rows_of(2, 90, 1000, 15)
    got = exact_vote(spark.createDataFrame(train, SCHEMA).repartition(3), spark.createDataFrame(test, SCHEMA), ["a", "b"], k=k, **sizes).collect()
    want = brute(train, test, k)
    assert len(got) == 90 and {r.pr_id: r.score for r in got} == pytest.approx(want)
    assert all(r.prediction == int(r.score > 0.5) for r in got)


def test_rows_meet_by_ring_and_few_of_them(spark, monkeypatch):
    """Far groups: a row meets its own group alone, and no join is without a key."""
    train = [(i, float(i % 40) * 1000 + (i // 40) * 0.1, 0.0, i % 2) for i in range(2000)]
    test = [(10_000 + i, float(i) * 1000 + 0.33, 0.0, 0) for i in range(40)]
    met, plain = [], exact_neighbours._met

    def counted(asked, known, ring):
        sent = asked.select("id", F.explode(ring).alias("r")).select("id", "r.ring")
        met.append(sent.join(known.select("ring"), "ring").count())
        return plain(asked, known, ring)

    monkeypatch.setattr(exact_neighbours, "_met", counted)
    out = exact_vote(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA), ["a", "b"], pivots=40, rings=4)
    assert {r.pr_id: r.score for r in out.collect()} == pytest.approx(brute(train, test, 5))
    assert max(met) < 0.2 * len(train) * len(test)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_missing_infinite_repeated_and_empty_rows(spark):
    train = spark.createDataFrame([(1, 0.0, 0.0, 1), (1, 0.0, 0.0, 1), (2, 9.0, 9.0, 0), (3, None, 0.0, 0), (4, math.nan, 0.0, 0)], SCHEMA)
    test = spark.createDataFrame([(7, -0.0, 0.0, 0), (7, 0.0, 0.0, 0), (None, 8.0, 8.0, 1), (8, None, 1.0, 1), (9, math.inf, 1.0, 1)], SCHEMA)
    got = sorted(((r.pr_id or 0, r.score, r.prediction) for r in exact_vote(train, test, ["a", "b"], k=1).collect()), key=repr)
    assert got == [(0, 0.0, 0), (7, 1.0, 1), (7, 1.0, 1), (8, None, None), (9, None, None)]
    assert exact_vote(train, test.limit(0), ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        exact_vote(train.limit(0), test, ["a", "b"])


def test_lists_of_rings_are_neither_written_nor_shuffled(spark, monkeypatch):
    """A row's list of all rings takes many times the row; rows of one small file are dealt before the lists are made."""
    train, test = rows_of(3, 300, 0, 30), rows_of(4, 80, 1000, 30)
    written, plain = {}, exact_neighbours.materialize

    def kept(df, label):
        written[label] = plain(df, label)
        return written[label]

    monkeypatch.setattr(exact_neighbours, "materialize", kept)
    out = exact_vote(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA).coalesce(1), ["a", "b"])
    assert not [f.name for f in written["first-bounds"].schema if f.dataType.simpleString().startswith("array<struct")]
    assert written["first-bounds"].select(F.spark_partition_id(), F.input_file_name()).distinct().count() > 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"(?m)^.*Generate explode\(filter\(.*\n(?:.*Project.*\n)+.*RepartitionByExpression \[id", plan), plan
    assert {r.pr_id: r.score for r in out.collect()} == pytest.approx(brute(train, test, 5))


def voted(spark, train, test, held, k):
    out = knn_vote(spark.createDataFrame(train, SCHEMA).repartition(3), spark.createDataFrame(test, SCHEMA), ["a", "b"], k=k, max_reference=held)
    return sorted(((r.pr_id or 0, r.label, None if r.score is None else round(r.score, 9), r.prediction) for r in out.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 5])
def test_all_labelled_rows_vote_beyond_what_a_task_holds(spark, k):
    train, test = rows_of(5, 240, 0, 40), rows_of(6, 60, 1000, 50)
    want = sorted(((key, label, round(s, 9), int(s > 0.5)) for (key, s), label in zip(brute(train, test, k).items(), [r[3] for r in test])), key=repr)
    assert voted(spark, train, test, 20, k) == want
    assert voted(spark, train, test, 240, k) == want


@pytest.mark.parametrize("whole", [0, 2, 30])
def test_odd_rows_vote_alike_held_or_not(spark, whole):
    """Null, missing, infinite and repeated values and rows; few or no labelled rows with a distance."""
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 3.0]
    train = [(i, odd[i % 4], odd[i % 7], i % 3 % 2) for i in range(28)] + [(100 + i, float(i % 5), float(i % 3), i % 2) for i in range(whole)]
    test = [(i % 40 or None, a, b, i % 2) for i, (a, b) in enumerate([(a, b) for a in odd for b in odd] * 2)]
    assert voted(spark, train, test, 3, 5) == voted(spark, train, test, 1000, 5)


def test_compared_metrics_do_not_depend_on_what_a_task_holds(spark):
    """The row of the vote in the table of models is that of all labelled rows."""
    from patchloom.plans import classify

    train, test = spark.createDataFrame(rows_of(7, 200, 0, 30), SCHEMA), spark.createDataFrame(rows_of(8, 80, 1000, 30), SCHEMA)
    names = ("model_name", "accuracy", "precision", "recall", "f1", "auc")
    held, spread = (classify.evaluation(knn_vote(train, test, ["a", "b"], max_reference=most), "knn").select(*names).first() for most in (200, 20))
    assert held.model_name == spread.model_name and list(spread)[1:] == pytest.approx(list(held)[1:])
    right = [int(score > 0.5) == label for score, label in zip(brute(rows_of(7, 200, 0, 30), rows_of(8, 80, 1000, 30), 5).values(), [r[3] for r in rows_of(8, 80, 1000, 30)])]
    assert spread.accuracy == pytest.approx(sum(right) / 80)
