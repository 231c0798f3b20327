"""The Gaussian kernel machine: kernel values, rings, probabilities."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.plans import classify, kernel


@pytest.fixture(scope="module")
def rings(spark):
    """Two rings around one centre; 600 rows."""
    turn = F.pmod(F.xxhash64("pr_id"), F.lit(1000)) / 1000.0 * 2 * math.pi
    wide = F.when(F.col("pr_id") % 2 == 0, 1.0).otherwise(3.0) + F.pmod(F.xxhash64("pr_id", F.lit(1)), F.lit(100)) / 250.0
    rows = spark.range(600).withColumnRenamed("id", "pr_id")
    return rows.select("pr_id", (wide * F.cos(turn)).alias("x"), (wide * F.sin(turn)).alias("y"), (F.col("pr_id") % 2).cast("int").alias("label")).persist()


def test_inner_products_approach_the_kernel(spark):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(6, 2))
    directions, shifts = kernel.draw_waves(2, 4000, 0.3)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i INT, x DOUBLE, y DOUBLE")
    got = rows.select("i", kernel.fourier_features(F.array("x", "y"), directions, shifts).alias("z")).orderBy("i").collect()
    z = np.array([r.z for r in got])
    want = np.exp(-0.3 * ((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_separates_rings_where_a_line_cannot(rings):
    train, test = rings.where("pr_id % 3 <> 0"), rings.where("pr_id % 3 = 0")
    machine = kernel.fit_kernel_machine(train, ["x", "y"], waves=64)
    scored = kernel.kernel_scores(machine, test).withColumn("n", F.lit(1)).persist()
    assert classify.auc(scored).first().auc > 0.95
    line, ready = classify.fit_model(rings.withColumn("is_test", (F.col("pr_id") % 3 == 0).cast("int")), ["x", "y"], "svm")
    assert abs(classify.auc(classify.scored(line, ready)).first().auc - 0.5) < 0.2
    rows = scored.orderBy("margin").collect()
    assert all(0 < r.score < 1 for r in rows) and all(a.score <= b.score for a, b in zip(rows, rows[1:], strict=False))
    assert np.mean([(r.score > 0.5) == bool(r.label) for r in rows]) > 0.95
    assert scored.columns[:4] == ["pr_id", "x", "y", "label"] and len(rows) == 200


def test_sigmoid_equals_a_plain_fit(spark):
    draw = np.random.default_rng(2)
    m = draw.normal(2, 3, 400)
    y = (draw.uniform(size=400) < 1 / (1 + np.exp(-(0.8 * m - 1)))).astype(int)
    got = kernel.fit_sigmoid(spark.createDataFrame(list(zip(m.tolist(), y.tolist(), strict=True)), "margin DOUBLE, label INT"))
    aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = b = 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(a * m + b)))
        a, b = a - 0.05 * np.mean((p - aim) * m), b - 0.05 * np.mean(p - aim)
    assert got == pytest.approx((a, b), abs=1e-3)


def test_sigmoid_of_separable_useless_and_missing_rows(spark):
    schema = "margin DOUBLE, label INT"
    slope, offset = kernel.fit_sigmoid(spark.createDataFrame([(-1.0, 0), (1.0, 1)] * 5, schema))
    assert 0 < slope < 100 and abs(offset) < 1e-6
    assert kernel.fit_sigmoid(spark.createDataFrame([(1.0, 0), (1.0, 1)], schema)) == (0.0, 0.0)
    assert kernel.fit_sigmoid(spark.createDataFrame([(-1.0, 1), (1.0, 0)] * 5, schema))[0] == 0.0
    assert kernel.fit_sigmoid(spark.createDataFrame([], schema)) == (0.0, 0.0)


def test_gamma_nulls_and_old_score_columns(spark, rings):
    assert kernel.scale_gamma(spark.createDataFrame([(0.0, 0.0), (2.0, 2.0)], "x DOUBLE, y DOUBLE"), ["x", "y"]) == 0.5
    assert kernel.scale_gamma(spark.createDataFrame([(3.0,)], "x DOUBLE"), ["x"]) == 1.0
    machine = kernel.fit_kernel_machine(rings, ["x", "y"], waves=4, iterations=2)
    odd = spark.createDataFrame([(1, None, None, "old", 5.0)], "pr_id LONG, x DOUBLE, y DOUBLE, score STRING, margin DOUBLE")
    zero = spark.createDataFrame([(1, 0.0, 0.0)], "pr_id LONG, x DOUBLE, y DOUBLE")
    got, want = kernel.kernel_scores(machine, odd).first(), kernel.kernel_scores(machine, zero).first()
    assert (got.margin, got.score) == (want.margin, want.score)
    assert kernel.kernel_scores(machine, odd.limit(0)).count() == 0
