"""Mixing sources to target weights: Pivotal dependent rounding of copy counts, with DataFrame functions only.

A source's target over its size is the number of copies of each of its documents. Whole copies are sure; the
fractions are paired within blocks of a source. A pair moves words from one to the other, at random and so that
no expectation changes, until one fraction is 0 or 1. What a block leaves over meets what other blocks leave over
in the next level, so a source of n documents needs about log64(n) small steps, and its words miss the target by
part of one document at most. Random numbers are hashes, so reruns agree.

Null texts have no words; a source is any value, null included and last in order. Rows that agree in doc_id,
source and size are one unit of several rows. Empty tables give empty results. If there are no words, targets
and copies are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize

#: Fractions met in one block, on average.
FAN_IN = 64
#: A source's words are taken this many times at most.
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, n, weight, target) from one row per source (source, source_size, n).

    Shares go by weights 1, 2, 3, repeating in order of the source. A target stops at ``most`` times its source;
    what is over goes to the others by weight: all share one level, the words per weight, and each stops at its cap.
    """
    ordered = sources.withColumn("weight", (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("long"))
    capped = ordered.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spread = capped.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return spread.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("source", "source_size", "n", "weight", "target")


def uniform(*columns: Column | str, seed: int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _meet(state: Column, b: Column, seed: int) -> Column:
    """Pair the waiting fraction with the next one; one of them becomes final."""
    a, done = state["waiting"], state["done"]
    room_a, held_a, room_b, held_b = (1 - a["p"]) * a["size"], a["p"] * a["size"], (1 - b["p"]) * b["size"], b["p"] * b["size"]
    to_a, to_b = F.least(room_a, held_b), F.least(held_a, room_b)
    goes_to_a = uniform(a["h"], b["h"], seed=seed) < F.coalesce(F.try_divide(to_b, to_a + to_b), F.lit(0.0))

    def leaves(final: Column, up: bool, waiting: Column, p: Column) -> Column:
        return F.struct(waiting.withField("p", p).alias("waiting"), F.array_append(done, final.withField("up", F.lit(up))).alias("done"))

    return (
        F.when(a.isNull(), F.struct(b.alias("waiting"), done.alias("done")))
        .when(goes_to_a & (to_a >= room_a), leaves(a, True, b, b["p"] - to_a / b["size"]))
        .when(goes_to_a, leaves(b, False, a, a["p"] + to_a / a["size"]))
        .when(to_b >= held_a, leaves(a, False, b, b["p"] + to_b / b["size"]))
        .otherwise(leaves(b, True, a, a["p"] - to_b / a["size"]))
    )


def _round_blocks(rows: DataFrame, seed: int) -> DataFrame:
    """rows: source, block, unit. Per block: the final units (``done``) and the one left over (``waiting``)."""
    kind = rows.schema["unit"].dataType.simpleString()
    gathered = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    start = F.struct(F.lit(None).cast(kind).alias("waiting"), F.array().cast(f"array<{kind}>").alias("done"))
    return gathered.select("source", "block", F.aggregate("units", start, lambda state, unit: _meet(state, unit, seed)).alias("out")).select("source", "block", "out.*")


def copies(sizes: DataFrame, seed: int = 11) -> DataFrame:
    """Units (doc_id, source, size, m rows) with source_size, target and ``copies``, to be shared among the m rows.

    sizes: doc_id, source, size, one row per document; only those columns are used.
    """
    sizes = sizes.select("doc_id", "source", "size")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    right = targets.withColumnRenamed("source", "_source").drop("weight")
    full = units.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.col("m") * F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    full = full.withColumn("base", F.floor(expected)).withColumn("p", expected - F.floor(expected)).withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))
    full = full.withColumn("block", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / FAN_IN)))
    unit = F.struct("h", "doc_id", "size", "m", "base", "source_size", "target", "p", F.lit(None).cast("boolean").alias("up")).alias("unit")
    full = materialize(full.select("source", "block", "n", unit), "fractions")
    paired = (F.col("unit.p") > 0) & (F.col("unit.size") > 0)
    blocks = full.agg(F.max(F.ceil(F.col("n") / FAN_IN))).first()[0] or 1

    level = materialize(_round_blocks(full.where(paired), seed), "rounding")
    done = [level.select("source", F.explode("done").alias("unit"))]
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        left = level.select("source", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("waiting").alias("unit"))
        level = materialize(_round_blocks(left, seed + len(done)), "rounding")
        done.append(level.select("source", F.explode("done").alias("unit")))
    alone = level.select("source", F.col("waiting").alias("unit")).union(full.where(~paired).select("source", "unit"))
    rounded = alone.withColumn("unit", F.col("unit").withField("up", uniform(F.col("unit.h"), seed=seed + 99) < F.col("unit.p")))
    for part in done:
        rounded = rounded.union(part)
    return rounded.select("unit.doc_id", "source", "unit.size", "unit.m", "unit.source_size", "unit.target", (F.col("unit.base") + F.col("unit.up").cast("long")).alias("copies"))


def share(number: Column) -> Column:
    """Copies of row ``number`` (from 1) of the ``m`` rows of a unit."""
    return F.floor(F.col("copies") / F.col("m")) + F.when(number <= F.col("copies") % F.col("m"), 1).otherwise(0)


def planned(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (words taken, repeats counted)."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = copies(sizes).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).withColumn("copies", share(F.col("_row")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, whatever their names, each as often as the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    sized = docs.select(whole, F.col("doc_id").alias("id"), F.col("source").alias("from"), word_count(F.col("text")).alias("words"))
    plan = copies(materialize(sized.select(F.col("id").alias("doc_id"), F.col("from").alias("source"), F.col("words").alias("size")), "sizes")).where("copies > 0")
    plan = plan.select("doc_id", "source", "size", "m", "copies")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    rows = sized.join(plan, same).withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("whole.text")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), share(F.col("number")))))
    return rows.where("copy > 0").select("whole.*")
