"""Second-order boosting against a plain one."""

from __future__ import annotations

import math

import numpy as np
import pytest

from patchloom.plans import boosting, classify

SCHEMA = "pr_id LONG, a DOUBLE, b DOUBLE, label INT"
EDGES = [[-1.0, -0.5, 0.0, 0.5, 1.0], [-0.75, 0.0, 0.75]]


def data(n=400):
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(size=(n, 2)), 3)
    y = ((x[:, 0] > 0.2) != (x[:, 1] > -0.1)).astype(int)
    y[draw.uniform(size=n) < 0.1] ^= 1
    return x, y


def plain(x, y, trees, depth, leaves, rate=0.3, l2=1.0, least=1.0):
    """The same trees over a list of row sets, without bins or sums."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)
        done, level = [], [np.ones(len(y), bool)]
        for _ in range(depth):
            found = []
            for s in level:
                best = None
                for f, edges in enumerate(EDGES):
                    for e in edges:
                        a, b = s & (x[:, f] <= e), s & (x[:, f] > e)
                        if min(h[a].sum(), h[b].sum()) >= least:
                            gain = 0.5 * (worth(a) + worth(b) - worth(s))
                            if gain > 0 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, a, b)
                found.append((best, s))
            found.sort(key=lambda t: -(t[0][0] if t[0] else -1))
            room = leaves - len(done) - len(level)
            level = []
            for best, s in found:
                if best and room > 0:
                    level += best[1:]
                    room -= 1
                else:
                    done.append(s)
        for s in done + level:
            margin[s] -= rate * g[s].sum() / (h[s].sum() + l2)
    return margin


@pytest.mark.parametrize("trees,depth,leaves,every", [(1, 1, 2, 8), (1, 3, 4, 8), (5, 3, 5, 2)])
def test_equals_plain_boosting(spark, trees, depth, leaves, every):
    x, y = data()
    rows = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], SCHEMA)
    model = boosting.fit_boosted_trees(rows, ["a", "b"], trees, depth, leaves, edges=EDGES, every=every)
    got = [r.margin for r in boosting.boosted_scores(model, rows).orderBy("pr_id").collect()]
    assert got == pytest.approx(plain(x, y, trees, depth, leaves), abs=1e-9)
    assert all(len(boosting.leaf_table(model, t)) <= leaves for t in range(trees))
    assert sum(n for _, n, _ in boosting.leaf_table(model)) == len(y)


def test_learns_what_one_split_cannot_and_same_result_elsewhere(spark):
    x, y = data(900)
    rows = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], SCHEMA)
    train, test = rows.where("pr_id % 3 > 0"), rows.where("pr_id % 3 = 0")
    model = boosting.fit_boosted_trees(train, ["a", "b"], trees=6, bins=16)
    assert classify.auc(boosting.boosted_scores(model, test)).first().auc > 0.85
    other = boosting.fit_boosted_trees(train.repartition(7), ["a", "b"], trees=6, bins=16)
    a, b = ([r.score for r in boosting.boosted_scores(m, test).orderBy("pr_id").collect()] for m in (model, other))
    assert a == pytest.approx(b, abs=1e-9)


def test_features_may_have_any_name(spark):
    x, y = data()
    rows = spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], SCHEMA)
    want = boosting.fit_boosted_trees(rows, ["a", "b"], 2, edges=EDGES)
    for names in (["y", "bins"], ["p", "x"], ["g", "leaf"]):
        named = rows.withColumnsRenamed(dict(zip("ab", names, strict=True)))
        got = boosting.fit_boosted_trees(named, names, 2, edges=EDGES)
        assert boosting.leaf_table(got) == [(i, n, pytest.approx(w)) for i, n, w in boosting.leaf_table(want)]


def test_nulls_one_class_constant_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, 1.0, 1), (2, math.nan, 1.0, 0), (3, 0.0, 1.0, None)] * 9, SCHEMA)
    model = boosting.fit_boosted_trees(rows, ["a", "b"], trees=2, edges=[[5.0], []])
    odd = spark.createDataFrame([(1, None, 1.0, "m", 3, 4.0), (2, math.nan, 1.0, "m", 3, 4.0)], "pr_id LONG, a DOUBLE, b DOUBLE, margin STRING, _bins INT, p DOUBLE")
    low, high = boosting.boosted_scores(model, odd).orderBy("pr_id").collect()
    assert low.score > 0.5 > high.score and low["_bins"] == 3 and low.p == 4.0
    same = boosting.fit_boosted_trees(rows.where("label = 1"), ["b"], trees=1)
    assert len(same.trees[0]) == 1 and boosting.boosted_scores(same, odd).first().score > 0.9
    none = boosting.fit_boosted_trees(rows.limit(0), ["a"], trees=1)
    assert boosting.boosted_scores(none, odd).first().score == 0.5
