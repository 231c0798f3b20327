"""Connected components over an edge table by alternating star contraction; every round is a few joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours under the least node of each neighbourhood: the larger ones, or else the smaller ones and the node itself."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = pairs if small else pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = around.join(least, "u")
    hung = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))) if small else hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node that it reaches. No edges, no rows."""
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), label)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
        seen = state
        now = materialize(_stars(_stars(now, small=False), small=True), label)
