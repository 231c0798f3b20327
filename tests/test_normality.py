"""The Shapiro-Wilk test: published samples, a plain version, ties."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from patchloom.operators import normality

WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def plain(values):
    x, n, inverse = sorted(values), len(values), NormalDist().inv_cdf
    m = [inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)

    def poly(factors):
        return sum(f * u ** (5 - i) for i, f in enumerate(factors))

    a = poly(normality.LAST_WEIGHT) + m[-1] / math.sqrt(mm)
    b = poly(normality.NEXT_WEIGHT) + m[-2] / math.sqrt(mm)
    if n > 5:
        scale = math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a * a - 2 * b * b))
        weights = [-a, -b, *[v / scale for v in m[2:-2]], b, a]
    else:
        scale = math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * a * a))
        weights = [-a, *[v / scale for v in m[1:-1]], a]
    mean = sum(x) / n
    return sum(w * v for w, v in zip(weights, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_inverse_normal(spark):
    shares = [1e-12, 1e-5, 0.02, 0.0243, 0.3, 0.5, 0.8, 0.97, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in shares], "p DOUBLE").select("p", F.expr(normality.inverse_normal("p")).alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=2e-9, abs=1e-12)


def test_published_sample(spark):
    got = normality.shapiro_wilk(spark.createDataFrame([(float(v),) for v in WEIGHTS], "v DOUBLE"), [], "v").first()
    assert got.n == 11 and got.w_stat == pytest.approx(0.7888, abs=5e-5) and got.p_value == pytest.approx(0.0067, abs=5e-5)


def test_equals_a_plain_version_with_ties_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(normality, "CHUNK", 7)
    groups = {"four": [1, 2, 4, 9], "five": [3, 3, 4, 8, 1], "twelve": list(range(11)) + [40], "ties": [5] * 30 + [i * i % 17 for i in range(60)]}
    extra = {"two": [1, 2], "same": [4, 4, 4, 4], "three": [1, 2, 4]}
    rows = [(g, float(v)) for g, vs in (groups | extra).items() for v in vs] + [("two", None), (None, 3.0)]
    got = {r.g: r for r in normality.shapiro_wilk(spark.createDataFrame(rows, "g STRING, v DOUBLE"), ["g"], "v").collect()}
    for g, vs in groups.items():
        assert got[g].w_stat == pytest.approx(plain(vs), abs=1e-8) and 0 <= got[g].p_value <= 1
    assert got["two"].w_stat is None and got["same"].w_stat is None and got["same"].p_value is None
    assert got["three"].w_stat == pytest.approx(0.5 * 9 / (14 / 3)) and got["three"].p_value is None
