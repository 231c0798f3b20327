"""Second-order boosted trees: gradient and curvature sums over quantile bins, one grouped aggregation per level.

The driver sees sums alone, leaves x features x bins of them, a number that parameters bound; rows are read where they are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.session import materialize, release


class Node(NamedTuple):
    """A leaf (``feature`` None), or a split: values up to the edge numbered ``bin`` go to ``left``, others to ``right``."""

    weight: float
    rows: int
    feature: int | None = None
    bin: int | None = None
    gain: float | None = None
    left: int | None = None
    right: int | None = None


class BoostedTrees(NamedTuple):
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    trees: tuple[dict[int, Node], ...]


def quantile_edges(rows: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """Up to ``bins - 1`` different edges per feature, about evenly filled bins."""
    shares = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [sorted({e for e in edges or [] if not math.isnan(e)}) for edges in got]


def binned(features: Sequence[str], edges: Sequence[Sequence[float]]) -> Column:
    """Per feature how many edges are below the value; a null counts as the least value, NaN as the greatest."""
    every = [F.from_json(F.lit(json.dumps(list(e))), "ARRAY<DOUBLE>") for e in edges]

    def one(name: str, own: Column) -> Column:
        value = F.col(f"`{name}`").cast("double")
        return F.size(F.filter(own, lambda e: e < value))

    return F.array(*[one(c, e) for c, e in zip(features, every, strict=True)])


def _walk(tree: Mapping[int, Node], bins: str, leaf: str, at: int = 0) -> str:
    """The tree as a CASE expression over a column of bins; ``leaf`` is the result, with the leaf's number and weight."""
    node = tree[at]
    if node.feature is None:
        return leaf.format(number=at, weight=repr(node.weight))
    sides = (_walk(tree, bins, leaf, side) for side in (node.left, node.right))
    return "CASE WHEN {}[{}] <= {} THEN {} ELSE {} END".format(bins, node.feature, node.bin, *sides)


def _best_split(cells: Mapping[int, Mapping[int, tuple]], total: tuple, l2: float, min_curvature: float):
    """(gain, feature, bin, sums left, sums right) of the greatest gain; of equal gains the first feature and bin."""

    def worth(g: float, h: float) -> float:
        return g * g / (h + l2)

    best = None
    for feature in sorted(cells):
        g = h = n = 0
        for number in sorted(cells[feature])[:-1]:
            own = cells[feature][number]
            g, h, n = g + own[0], h + own[1], n + own[2]
            rest = (total[0] - g, total[1] - h, total[2] - n)
            if min(h, rest[1]) < min_curvature:
                continue
            gain = 0.5 * (worth(g, h) + worth(*rest[:2]) - worth(*total[:2]))
            if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                best = (gain, feature, number, (g, h, n), rest)
    return best


def grow_tree(
    rows: DataFrame, max_depth: int, max_leaves: int, l2: float, min_gain: float, min_curvature: float, rate: float
) -> dict[int, Node]:
    """One tree on rows (bins, g, h). The leaves of a level are split in the order of their gains while leaves are left to give."""
    tree, fresh, leaves = {0: Node(0.0, 0)}, {0: None}, 1

    def leaf_of(sums: tuple) -> Node:
        return Node(-rate * sums[0] / (sums[1] + l2) if sums[1] + l2 > 0 else 0.0, sums[2])

    for _ in range(max_depth):
        if not fresh or leaves >= max_leaves:
            break
        here = F.expr(_walk(tree, "bins", "{number}")).alias("leaf")
        cells = rows.select(here, "g", "h", F.posexplode("bins").alias("feature", "bin")).where(F.col("leaf").isin(*fresh))
        sums = cells.groupBy("leaf", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.count("*")).collect()
        table: dict[int, dict[int, dict[int, tuple]]] = {}
        for number, feature, place, g, h, n in sums:
            table.setdefault(number, {}).setdefault(feature, {})[place] = (g, h, n)
        found = []
        for number, own in table.items():
            first = own[min(own)].values()
            total = fresh[number] or tuple(sum(part) for part in zip(*first, strict=True))
            tree[number] = leaf_of(total)
            best = _best_split(own, total, l2, min_curvature)
            if best and best[0] > min_gain:
                found.append((best, number))
        fresh = {}
        for best, number in sorted(found, key=lambda f: (-f[0][0], f[1]))[: max_leaves - leaves]:
            gain, feature, place, left, right = best
            a, b = len(tree), len(tree) + 1
            tree[number] = tree[number]._replace(feature=feature, bin=place, gain=gain, left=a, right=b)
            tree |= {a: leaf_of(left), b: leaf_of(right)}
            fresh |= {a: left, b: right}
            leaves += 1
    return tree


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    trees: int = 20,
    max_depth: int = 4,
    max_leaves: int = 12,
    rate: float = 0.3,
    l2: float = 1.0,
    min_gain: float = 0.0,
    min_curvature: float = 1.0,
    bins: int = 32,
    edges: Sequence[Sequence[float]] | None = None,
    every: int = 8,
) -> BoostedTrees:
    """Fit to ``label`` 0 or 1 under logistic loss. A leaf weighs -G / (H + l2), by the sums of gradients and curvatures of its
    rows, times ``rate``. Scores start at the log odds of the labels, smoothed by one row of each kind; they are written once per
    ``every`` trees. Rows without a label take no part; a table without rows gives trees of weight 0."""
    edges = [list(e) for e in edges] if edges is not None else quantile_edges(train, features, bins)
    # The bins come first: a lambda takes the name of a column for that of an alias before it.
    labelled = train.where(F.col("label").isin(0, 1))
    rows = labelled.select(binned(features, edges).alias("bins"), F.col("label").cast("double").alias("y"))
    ones, count = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    base = math.log((ones + 1) / (count - ones + 1))
    rows, grown = materialize(rows.withColumn("margin", F.lit(base)), "binned"), []
    since: list[dict[int, Node]] = []
    for _ in range(trees):
        margin = F.expr(" + ".join(["margin", *[f"({_walk(t, 'bins', '{weight}D')})" for t in since]]))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        sums = rows.select("y", "bins", p.alias("p")).select("bins", (F.col("p") - F.col("y")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        tree = grow_tree(sums, max_depth, max_leaves, l2, min_gain, min_curvature, rate)
        grown.append(tree)
        since.append(tree)
        if len(since) == every and len(grown) < trees:
            margin = F.expr(" + ".join(["margin", *[f"({_walk(t, 'bins', '{weight}D')})" for t in since]]))
            written = materialize(rows.withColumn("margin", margin), "margins")
            release(rows)
            rows, since = written, []
    release(rows)
    return BoostedTrees(tuple(features), tuple(map(tuple, edges)), base, tuple(grown))


def boosted_scores(model: BoostedTrees, rows: DataFrame) -> DataFrame:
    """Adds ``margin``, ``score`` (probability of class 1) and ``prediction`` INT; columns of these names are replaced."""
    kept = rows.drop("margin", "score", "prediction")
    place = "_bins"
    while place in kept.columns:
        place += "_"
    sums = " + ".join([f"{model.base!r}D", *[f"({_walk(t, place, '{weight}D')})" for t in model.trees]])
    out = kept.withColumn(place, binned(model.features, model.edges)).withColumn("margin", F.expr(sums)).drop(place)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return out.withColumn("score", score).withColumn("prediction", (F.col("margin") > 0).cast("int"))


def leaf_table(model: BoostedTrees, number: int = 0) -> list[tuple[int, int, float]]:
    """(leaf, rows, weight) of one tree."""
    return [(i, n.rows, n.weight) for i, n in sorted(model.trees[number].items()) if n.feature is None]
