"""Exact nearest neighbours among all labelled rows: pivots, rings around them, and the triangle inequality.

Labelled rows belong to their nearest pivot and, by their distance to it, to a ring. A row of the other table looks into
one ring first; the k-th distance found there bounds the answer, and only rings that reach below the bound are met in a
second round. Nothing is left out, whatever the number of rows, and rows of two tables meet by ring, never all with all.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.operators.sampling import sample_n
from patchloom.session import materialize

#: Bounds are compared with this much room for rounding; it only lets more rings and rows through.
ROOM = 1e-9


def _vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def is_known(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t)


def _constant(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"ARRAY<{kind}>")


def first_k(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per group; tasks cut their rows to k per group before the shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k)


def _in_rings(rows: DataFrame, pivots: int, rings: int, part_rows: int, seed: int) -> tuple[DataFrame, Column, Column]:
    """The labelled rows with ``ring`` and ``part``, the pivots, and the rings (number, pivot, least and greatest distance, rows, parts).
    Pivots and rings are of bounded number, by the parameters; a ring of many rows is dealt to parts of about ``part_rows``."""
    chosen = sample_n(rows.where(F.col("_rank") == 1).select("near", "vec"), pivots, ["near"], seed)
    centres = _constant([r.vec for r in chosen.collect()], "ARRAY<DOUBLE>")
    away = F.transform(centres, lambda c: F.sqrt(squared(F.col("vec"), c)))
    placed = rows.drop("_rank").withColumn("_away", away).withColumn("away", F.array_min("_away"))
    placed = materialize(placed.withColumn("cell", (F.array_position("_away", F.col("away")) - 1).cast("int")).drop("_away"), "cells")
    shares = [i / rings for i in range(1, rings)] or [1.0]
    cuts = dict(placed.groupBy("cell").agg(F.percentile_approx("away", shares, 1000)).collect())
    edges = _constant([sorted(set(cuts.get(c, []))) for c in range(max(cuts) + 1)], "ARRAY<DOUBLE>")
    below = F.size(F.filter(F.get(edges, F.col("cell")), lambda e: e < F.col("away")))
    ringed = placed.withColumn("ring", F.col("cell") * F.lit(rings + 1) + below)
    stats = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    table = [{"ring": r.ring, "cell": r.cell, "low": r.low, "high": r.high, "n": r.n, "parts": -(-r.n // part_rows)} for r in stats]
    kinds = "STRUCT<ring: INT, cell: INT, low: DOUBLE, high: DOUBLE, n: BIGINT, parts: INT>"
    parts = [0] * (max(t["ring"] for t in table) + 1)
    for t in table:
        parts[t["ring"]] = t["parts"]
    part = F.pmod(F.xxhash64("near"), F.get(_constant(parts, "INT"), F.col("ring"))).cast("int")
    return ringed.select("near", "y", "vec", "ring", part.alias("part")), centres, _constant(table, kinds)


def _met(asked: DataFrame, known: DataFrame, ring: Column) -> DataFrame:
    """Rows asked (id, vec, bound) beside the labelled rows of their rings that lie within the bound."""
    sent = asked.select("id", "vec", "bound", F.explode(ring).alias("r")).select(
        "id", F.col("vec").alias("own"), "bound", F.col("r.ring").alias("ring"), F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part")
    )
    pairs = sent.join(known, ["ring", "part"]).withColumn("d", squared(F.col("own"), F.col("vec")))
    return pairs.where(F.sqrt("d") <= F.col("bound") * (1 + ROOM)).select("id", "near", "y", "d")


def exact_neighbours(
    train: DataFrame,
    asked: DataFrame,
    k: int,
    pivots: int = 32,
    rings: int = 16,
    part_rows: int = 4096,
    seed: int = 42,
) -> DataFrame:
    """(id, near, y, d): the ``k`` nearest rows of ``train`` (near, y, vec) per row of ``asked`` (id, vec) by squared distance
    ``d``, then by ``near``; all rows when there are fewer. Of equal vectors only the first ``k`` can matter: others are dropped
    before anything else, so that many equal rows cost nothing. Vectors must be finite."""
    rows = materialize(first_k(train, ["vec"], ["near"], k), "distinct-vectors")
    if rows.isEmpty():
        raise ValueError("no labelled rows to vote")
    known, centres, table = _in_rings(rows, pivots, rings, part_rows, seed)
    known = materialize(known, "rings")

    def reach(ring: Column) -> Column:
        away = F.get(F.col("far"), ring["cell"])
        slack = F.lit(ROOM) * (away + ring["high"])
        return F.struct(
            F.greatest(F.lit(0.0), away - ring["high"] - slack, ring["low"] - away - slack).alias("least"),
            (away + ring["high"] + slack).alias("most"),
            ring["ring"].alias("ring"),
            ring["n"].alias("n"),
            ring["parts"].alias("parts"),
        )

    def reached(rows: DataFrame) -> DataFrame:
        far = rows.withColumn("far", F.transform(centres, lambda c: F.sqrt(squared(F.col("vec"), c))))
        return far.withColumn("reach", F.transform(table, reach)).drop("far")

    # Rows are dealt before their rings are listed: few files would else be bounded in few tasks.
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = reached(asked.select("id", "vec").repartition(tasks, "id"))
    # The k-th distance is at most that of the farthest ring needed to have k rows.
    by_most = F.array_sort(F.transform("reach", lambda r: F.struct(r["most"].alias("most"), r["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(math.inf).alias("most"))
    filled = F.aggregate(
        by_most, start, lambda a, r: F.when(a["n"] >= k, a).otherwise(F.struct((a["n"] + r["n"]).alias("n"), r["most"].alias("most")))
    )
    bounded = dealt.withColumn("_f", filled).select(
        "id", "vec", F.array_min("reach").alias("home"), F.when(F.col("_f.n") >= k, F.col("_f.most")).otherwise(F.lit(math.inf)).alias("bound")
    )
    # A row's list of all rings takes many times the row: it is neither written nor shuffled, but made anew for the second round.
    bounded = materialize(bounded, "first-bounds")
    home = first_k(_met(bounded, known, F.array("home")), ["id"], ["d", "near"], k)
    kth = home.groupBy("id").agg(F.max("d").alias("d"), F.count("*").alias("n")).where(F.col("n") == k)
    seen = bounded.drop("home").join(kth.select("id", F.sqrt("d").alias("seen")), "id", "left")
    tight = reached(seen.withColumn("bound", F.least("bound", "seen")).repartition(tasks, "id"))
    within = F.filter("reach", lambda r: r["least"] <= F.col("bound") * (1 + ROOM))
    return first_k(_met(tight, known, within), ["id"], ["d", "near"], k).drop("_rank")


def exact_vote(
    train: DataFrame, test: DataFrame, features: Sequence[str], key: str = "pr_id", label: str = "label", k: int = 5, **sizes: int
) -> DataFrame:
    """(key, label, score, prediction) of every test row: the share of label 1 among its ``k`` nearest labelled rows, equal
    distances by key. A labelled row with a missing or infinite feature takes no part, a test row with one has a null score.
    Equal test rows are looked up once."""
    vec = _vector(features)
    known = train.select(F.col(key).alias("near"), F.col(label).cast("double").alias("y"), vec.alias("vec")).where(is_known(F.col("vec")))
    rows = test.select(F.col(key), F.col(label), vec.alias("_vec"))
    distinct = rows.where(is_known(F.col("_vec"))).groupBy(F.col("_vec").alias("vec")).agg(F.count("*").alias("n"))
    asked = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), "vec"), "asked")
    votes = exact_neighbours(known, asked, k, **sizes).groupBy("id").agg(F.avg("y").alias("score"))
    by_vector = asked.join(votes, "id").select(F.col("vec").alias("_vec"), "score")
    return rows.join(by_vector, "_vec", "left").select(key, label, "score", (F.col("score") > 0.5).cast("int").alias("prediction"))
