"""k-nearest-neighbour vote among all labelled rows.

Up to ``max_reference`` of them, a parameter, every task holds them all. Test rows of any number pass by them in
batches: a batch meets the reference in blocks and keeps a running top k per row, so nothing is joined, shuffled or
expanded, whatever the values. More labelled rows stay distributed: the same vote comes from rings around pivots
(``exact_neighbours``), and no labelled row is left out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.plans.exact_neighbours import exact_neighbours, first_k, is_known, squared
from patchloom.session import materialize

# Workers get the functions themselves; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_REFERENCE = 50_000
BLOCK_ROWS = 1024


def nearest_votes(points: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int, block_rows: int) -> np.ndarray:
    """Mean label of the k nearest known rows per point; of equal distances the earlier row counts."""
    best_d = np.empty((len(points), 0))
    best_y = np.empty((len(points), 0))
    for start in range(0, len(known), block_rows):
        block = known[start : start + block_rows]
        d = np.zeros((len(points), len(block)))
        for j in range(known.shape[1]):
            gap = points[:, j : j + 1] - block[None, :, j]
            d += gap * gap
        y = np.broadcast_to(labels[start : start + block_rows], d.shape)
        d, y = np.concatenate([best_d, d], axis=1), np.concatenate([best_y, y], axis=1)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        best_d, best_y = np.take_along_axis(d, near, 1), np.take_along_axis(y, near, 1)
    return best_y.mean(axis=1)


def _pattern(vec: Column) -> Column:
    """What a vector with missing or infinite values is known by: infinities stay, finite values become 0, and one missing
    value makes all of them missing."""
    infinite = F.transform(vec, lambda x: F.when(F.abs(x) == F.lit(math.inf), x).otherwise(F.lit(0.0)))
    return F.when(F.exists(vec, F.isnan), F.transform(vec, lambda _: F.lit(math.nan))).otherwise(infinite)


def _behind(known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(id, beyond, near, y): the first ``k`` labelled rows at an infinite distance (``beyond`` 1), then at none (2). The
    distance between finite vectors is left to the rings; all others follow from the few patterns of the asked rows."""
    patterns = asked.select("pattern").distinct()
    finite = F.forall("pattern", lambda x: x == 0.0)
    pairs = known.crossJoin(F.broadcast(patterns)).where(~(finite & is_known(F.col("vec"))))
    beyond = F.when(F.isnan(squared(F.col("pattern"), F.col("vec"))), 2).otherwise(1)
    first = first_k(pairs.select("pattern", beyond.alias("beyond"), "near", "y"), ["pattern"], ["beyond", "near"], k)
    return asked.join(first, "pattern").select("id", "beyond", "near", "y")


def _vote_of_all(known: DataFrame, test: DataFrame, key: str, label: str, vec: Column, k: int) -> DataFrame:
    """(key, label, score) of every test row by labelled rows (near, y, vec) of any number; equal test rows are looked up once."""
    rows = test.select(F.col(key), F.col(label), vec.alias("_vec"))
    distinct = rows.groupBy(F.col("_vec").alias("vec")).agg(F.count("*").alias("n"))
    asked = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "vec", _pattern(F.col("vec")).alias("pattern")), "asked")
    found = _behind(known, asked, k).withColumn("d", F.lit(0.0))
    whole = known.where(is_known(F.col("vec")))
    if not whole.isEmpty():
        near = exact_neighbours(whole, asked.where(is_known(F.col("vec"))), k)
        found = found.unionByName(near.withColumn("beyond", F.lit(0)))
    score = F.when(F.count("y") == F.count("*"), F.avg("y"))
    votes = first_k(found, ["id"], ["beyond", "d", "near"], k).groupBy("id").agg(score.alias("score"))
    by_vector = asked.join(votes, "id").select(F.col("vec").alias("_vec"), "score")
    return rows.join(by_vector, "_vec").select(key, label, "score")


def knn_vote(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    key: str = "pr_id",
    label: str = "label",
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    max_reference: int = MAX_REFERENCE,
    batch_rows: int = 256,
) -> DataFrame:
    """(key, label, score, prediction): score is the share of label 1 among the k nearest labelled
    rows by Euclidean distance; equal distances go by key. All labelled rows take part; up to ``max_reference`` of them are
    held by every task. A null feature is at distance null, behind all others."""
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    known = train.select(F.col(key).alias("near"), F.col(label).cast("double").alias("y"), vec.alias("vec"))
    total = known.count()
    if not total:
        raise ValueError("no labelled rows to vote")
    if total > max_reference:
        voted = _vote_of_all(known, test, key, label, vec, k)
        return voted.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    rows = sorted(known.collect(), key=lambda r: (r.near is not None, r.near))
    reference = train.sparkSession.sparkContext.broadcast(
        (np.array([r.vec for r in rows], dtype=float), np.array([r.y for r in rows], dtype=float))
    )

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, labels = reference.value
        for vectors in batches:
            parts = [
                nearest_votes(np.stack(vectors.iloc[i : i + batch_rows].to_list()), known, labels, k, block_rows)
                for i in range(0, len(vectors), batch_rows)
            ]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    # Test rows are dealt before they vote: those of few files would else meet the whole reference in few tasks.
    dealt = test.repartition(int(test.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    voted = dealt.select(F.col(key), F.col(label), vote(vec).alias("score"))
    return voted.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
