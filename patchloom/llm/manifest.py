"""Merkle dataset manifest by nested-interval labels.

Every row is a leaf with a rank in its tree (one tree per value of a column). A node of level k covers an interval
of leaf ranks that begins at a multiple of ``FAN ** k``; so the node of a level that contains an interval is found by
an equality join on the level's bucket, the interval's begin divided by the level's width, and no key has more than
``FAN`` rows on the lower side. Siblings are what is left of the parent's interval without one's own: the children
that begin before it and those that begin at its end or later.

1. One pass over the texts gives each leaf's digest, and that of its tampered form; texts are not moved.
2. Ranks: leaves are range-sorted by (tree, doc_id, digest); counts per range and tree give the offsets.
3. Levels are built upwards by grouping on the bucket, written one by one; a tree stops at one node, its subroot.
   Subroots are the leaves of the tree of trees, whose last node is the root.
4. Downwards, each level's containment join gives nodes the siblings and ancestors of their parent.

Each of the six input columns may be null (marked in the digest) and texts may be empty or long. Leaves without doc_id
come first; rows equal in doc_id are ordered by digest, equal rows have equal proofs' digests. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize, partitions

#: Children of a node.
FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of the inputs behind each other."""
    return F.sha2(F.concat(*[x.cast("binary") for x in texts]), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    return digest(*[field(F.col(c) if c != "text" or text is None else text) for c in COLUMNS])


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, shown): the digest of each row, and of the row with the text ``tampered`` as someone shows it."""
    return docs.select(F.col("lang").alias("tree"), "doc_id", leaf().alias("leaf"), (leaf() if tampered is None else leaf(tampered)).alias("shown"))


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with lo (rank in the tree, from 0) and n (leaves of the tree). Ties share out over the ranges in any order."""
    spark = rows.sparkSession
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (tree, *order, "tie")]
    placed = materialize(spread.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).drop("tie").withColumn("place", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("part", tree).agg(F.min("place").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy(tree)
    offsets = counts.select("part", F.col(tree).alias("t"), (F.sum("c").over(whole.orderBy("part")) - F.col("c") - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    joined = placed.join(offsets.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col(tree).eqNullSafe(F.col("t")))
    return joined.select(*rows.columns, (F.col("place") + F.col("shift")).alias("lo"), "n")


def width(level: int) -> int:
    return FAN**level


def parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level`` from those below, in trees that still have several there: (tree, n, lo, hi, digest, children)."""
    below = nodes.where(F.col("n") > width(level - 1))
    grouped = below.groupBy("tree", "n", F.floor(F.col("lo") / width(level)).cast("long").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "digest"))).alias("children"))
    lo = F.col("bucket") * width(level)
    inside = F.transform("children", lambda c: c["digest"])
    return grouped.select("tree", "n", lo.alias("lo"), F.least(lo + width(level), "n").alias("hi"), digest(F.concat_ws("", inside)).alias("digest"), "children")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The written levels above the leaves (tree, n, lo, digest), until each tree has one node."""
    out, highest = [], nodes.agg(F.max("n")).first()[0] or 0
    while highest > width(len(out)):
        nodes = materialize(parents(nodes, len(out) + 1), f"level-{len(out) + 1}")
        out.append(nodes)
    return out


def contained(nodes: DataFrame, level: int, above: DataFrame) -> DataFrame:
    """Nodes (tree, lo, …) of ``level`` with their parent: equality on the bucket of the parent's level finds the interval that contains them.

    ``above`` has path and the names; path grows in front by the siblings before and after."""
    up = above.select(F.col("tree").alias("t"), F.floor(F.col("lo") / width(level + 1)).cast("long").alias("bucket"), F.col("children").alias("run"), "path", "subroot", "root")
    own = F.floor(F.col("lo") / width(level + 1)).cast("long")
    joined = nodes.join(up, nodes["tree"].eqNullSafe(up["t"]) & (own == F.col("bucket")))
    end = F.col("lo") + width(level)
    before = F.transform(F.filter("run", lambda c: c["lo"] < F.col("lo")), lambda c: c["digest"])
    after = F.transform(F.filter("run", lambda c: c["lo"] >= end), lambda c: c["digest"])
    step = F.struct(F.concat_ws("", before).alias("before"), F.concat_ws("", after).alias("after"))
    return joined.select(*nodes.columns, F.concat(F.array(step), "path").alias("path"), "subroot", "root")


def attached(nodes: DataFrame, built: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves ``nodes`` with path, subroot and root. ``tops``: (tree, path, subroot, root), what lies above each tree's last node."""

    def begin(rows: DataFrame, level: int) -> DataFrame:
        """Those that are their tree's last node take what lies above the tree."""
        last = rows.where(F.col("n") <= width(level))
        up = tops.withColumnRenamed("tree", "t")
        return last.join(up, last["tree"].eqNullSafe(up["t"])).drop("t")

    known = None
    for level in range(len(built), -1, -1):
        rows = built[level - 1] if level else nodes
        done = begin(rows, level)
        if known is not None:
            done = done.unionByName(contained(rows.where(F.col("n") > width(level)), level, known))
        known = done if level == 0 else materialize(done, f"paths-{level}")
    return known


def subroots(nodes: DataFrame, built: list[DataFrame]) -> DataFrame:
    """(tree, digest): the last node of each tree."""
    out = nodes.where(F.col("n") == 1).select("tree", "digest")
    for level, rows in enumerate(built, 1):
        out = out.unionByName(rows.where((F.col("n") > width(level - 1)) & (F.col("n") <= width(level))).select("tree", "digest"))
    return out


def manifest(rows: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Ranked leaves, the levels above them, and the tops (tree, path, subroot, root) from (tree, doc_id, leaf, …)."""
    nodes = materialize(ranked(materialize(rows, "leaves"), "tree", "doc_id", "leaf").withColumn("digest", F.col("leaf")), "ranked")
    built = levels(nodes)
    trees = materialize(subroots(nodes, built).select(F.lit(0).alias("all"), F.col("tree").alias("name"), F.col("digest")), "subroots")
    over = materialize(ranked(trees, "all", "name").withColumnRenamed("all", "tree"), "trees")
    upper = levels(over)
    root = subroots(over, upper).select(F.lit(0).alias("tree"), F.expr("array_repeat(struct('' as before, '' as after), 0)").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = attached(over, upper, root).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return nodes, built, materialize(tops, "tops")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, give."""
    return F.aggregate(path, start, lambda below, step: digest(step["before"], below, step["after"]))


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path (siblings before and after, level by level upwards), folded_root (from the
    shown leaf) and verified (whether that is the root)."""
    nodes, built, tops = manifest(leaves(docs, tampered))
    rows = attached(nodes, built, tops).select("doc_id", "leaf", "subroot", "root", "path", folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    return digest(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def lowered_thirds() -> Column:
    """The text with A-Z in lower case where 3 divides the crc32 of the decimal doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate(F.col("text").cast("string"), UPPER, LOWER)).otherwise(F.col("text").cast("string"))
