"""Exact attributions of tree scores: a table of the paths of a forest, and every subset of a path's features weighed."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators.sampling import sample_n
from patchloom.session import scratch_dir

# Workers get the functions themselves; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One row per tree, leaf and feature on the way: the leaf's part of the score, the interval (low, high] of the feature
#: that leads there, and the share of training rows that its splits let through. A tree that is one leaf has a row without feature.
PATHS = "tree INT, leaf INT, value DOUBLE, feature INT, low DOUBLE, high DOUBLE, share DOUBLE"

#: Numbers in one block of a task: rows times leaves times features of a path.
BLOCK = 2_000_000


def _paths_of_tree(nodes: pd.DataFrame) -> pd.DataFrame:
    at = nodes.set_index("id").to_dict("index")
    rows, todo = [], [(0, {})]
    while todo:
        number, way = todo.pop()
        node = at[number]
        if node["left"] < 0:
            steps = way or {None: (None, None, None)}
            rows += [(node["tree"], number, node["value"], feature, *step) for feature, step in steps.items()]
            continue
        feature, cut = int(node["feature"]), node["threshold"]
        low, high, share = way.get(feature, (-np.inf, np.inf, 1.0))
        for child, interval in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
            passed = share * at[child]["cover"] / node["cover"]
            todo.append((child, way | {feature: (*interval, passed)}))
    names = ["tree", "leaf", "value", "feature", "low", "high", "share"]
    return pd.DataFrame(rows, columns=names).astype({"feature": "Int32"})


def forest_paths(spark: SparkSession, model: Model) -> DataFrame:
    """The path table of a random forest (its leaves add up to the probability of class 1) or of boosted trees (to the
    margin). Nodes are read from the saved model, and a task walks one tree. Splits on categories are refused."""
    node = F.col("nodeData")
    stats, tree = node["impurityStats"], F.col("treeID")
    if isinstance(model, RandomForestClassificationModel):
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value = F.get(stats, 1) / cover / F.lit(float(len(model.treeWeights)))
    elif isinstance(model, GBTClassificationModel):
        cover = F.get(stats, 0)
        value = node["prediction"] * F.get(F.array(*[F.lit(float(w)) for w in model.treeWeights]), tree)
    else:
        raise ValueError(f"no trees in a {type(model).__name__}")
    folder = scratch_dir(spark, "forest")
    model.write().save(folder)
    split = node["split"]
    refused = F.raise_error(F.lit("a split on categories has no interval")).cast("double")
    nodes = spark.read.parquet(f"{folder}/data").select(
        tree.alias("tree"),
        node["id"].alias("id"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"),
        F.when(split["numCategories"] >= 0, refused).otherwise(F.get(split["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        value.alias("value"),
        cover.alias("cover"),
    )
    return nodes.groupBy("tree").applyInPandas(_paths_of_tree, PATHS)


def _tables(paths: DataFrame) -> dict[str, np.ndarray]:
    """The path table as arrays of leaves by steps. A missing step is a feature that lets everything through: it changes
    no attribution. Its size is that of the model, whatever the number of rows."""
    rows = paths.toPandas().sort_values(["tree", "leaf", "feature"], kind="stable")
    leaf = rows.groupby(["tree", "leaf"], sort=False).ngroup().to_numpy()
    step = rows.groupby(["tree", "leaf"], sort=False).cumcount().to_numpy()
    shape = (leaf.max() + 1, step.max() + 1) if len(rows) else (0, 1)
    out = {}
    for name, missing in (("value", 0.0), ("feature", 0), ("low", -np.inf), ("high", np.inf), ("share", 1.0)):
        grid = np.full(shape, missing, dtype=type(missing))
        grid[leaf, step] = rows[name].fillna(missing)
        out[name] = grid
    out["value"] = out["value"][:, 0]
    return out


def _weighed(x: np.ndarray, paths: Mapping[str, np.ndarray], features: int) -> np.ndarray:
    """Attributions of the rows ``x``, then their scores.

    A subset of s of the other m - 1 features of a path has the weight s! (m - 1 - s)! / m!, the integral of
    t^s (1 - t)^(m - 1 - s). The sum over all subsets is thus the integral of a product over the features, a polynomial
    that Gauss-Legendre nodes integrate without error.
    """
    value, feature, share = paths["value"], paths["feature"], paths["share"]
    leaves, steps = feature.shape
    at = x[:, feature]
    low, high = paths["low"], paths["high"]
    inside = ((low == -np.inf) | ~(at <= low)) & ((high == np.inf) | (at <= high))
    gained = np.zeros(at.shape)
    nodes, weights = np.polynomial.legendre.leggauss((steps + 1) // 2)
    for t, weight in zip((nodes + 1) / 2, weights / 2, strict=True):
        factor = share * (1 - t) + inside * t
        before, after = np.ones(at.shape), np.ones(at.shape)
        np.cumprod(factor[:, :, :-1], axis=2, out=before[:, :, 1:])
        np.cumprod(factor[:, :, :0:-1], axis=2, out=after[:, :, -2::-1])
        gained += weight * before * after
    gained *= (inside - share) * value[:, None]
    out = np.zeros((len(x), features + 1))
    flat, order = gained.reshape(len(x), leaves * steps), np.argsort(feature, axis=None, kind="stable")
    present, starts = np.unique(feature.ravel()[order], return_index=True)
    if leaves:
        out[:, present] = np.add.reduceat(flat[:, order], starts, axis=1)
    out[:, features] = inside.all(axis=2) @ value
    return out


def tree_attributions(paths: DataFrame, rows: DataFrame, features: Sequence[str], key: str = "pr_id") -> DataFrame:
    """Exact Shapley values of a score given by a path table: (key, feature, feature_value, attribution, score, base_score).

    A feature outside a subset is averaged by the shares of training rows, as trees do for a missing value. The
    attributions of a row add up to ``score - base_score``; ``base_score`` is the same for all rows. Nulls go where a
    comparison fails, to the right. Repeated rows give repeated results; an empty table gives none. Nothing is shuffled:
    a task goes through its rows in blocks, with the path table beside it.
    """
    tables = _tables(paths)
    count, block = len(features), max(1, BLOCK // max(1, tables["feature"].size))
    base = float((tables["share"].prod(axis=1) * tables["value"]).sum())

    @F.pandas_udf("array<double>")
    def weighed(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
        parts = [_weighed(x[i : i + block], tables, count) for i in range(0, len(x), block)]
        return pd.Series([list(r) for part in parts for r in part])

    values = [F.col(f"`{c}`").cast("double") for c in features]
    got = rows.select(F.col(key), F.array(*values).alias("own"), weighed(*values).alias("all"))
    labels = F.array(*[F.lit(n) for n in features])
    split = got.select(key, "own", F.get("all", count).alias("score"), F.posexplode(F.slice("all", 1, count)).alias("at", "attribution"))
    return split.select(
        key,
        F.get(labels, F.col("at")).alias("feature"),
        F.get("own", F.col("at")).alias("feature_value"),
        "attribution",
        "score",
        F.lit(base).alias("base_score"),
    )


def cutoff_tables(
    attributed: DataFrame, limits: Mapping[str, tuple[float | None, float]], n: int = 2000, seed: int = 42, key: str = "pr_id"
) -> DataFrame:
    """The tables behind value-against-attribution plots: per listed feature ``n`` sampled rows, of them those with a
    value below the first limit (None: all), and whether they lie beyond the second, the mark of the plot."""
    out = None
    for feature, (below, mark) in limits.items():
        rows = sample_n(attributed.where(F.col("feature") == F.lit(feature)), n, [key], seed)
        if below is not None:
            rows = rows.where(F.col("feature_value") < F.lit(float(below)))
        rows = rows.select(key, "feature", "feature_value", "attribution", (F.col("feature_value") > F.lit(float(mark))).alias("beyond_mark"))
        out = rows if out is None else out.unionByName(rows)
    return out
