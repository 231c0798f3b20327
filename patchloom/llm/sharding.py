"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

Equal texts are one key. A key falls on a cell of the ring; the next virtual node clockwise names its shard. No
shard takes more than its capacity (the mean load and ``SLACK``): what finds it full goes on clockwise to the next
node with room. The walk runs over the loads of the ``CELLS`` cells and over the heavy keys (above a thousandth of
a capacity, so ``1000 * shards`` at most), both of bounded number; the largest are placed first. A key above the
capacity of a shard is dealt over the ring by doc_id. All other keys stay whole.

Null texts count as empty. Rows that agree in doc_id and text get slots one after the other. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize

SHARDS, NODES, CELLS, BUCKETS = 16, 64, 16_384, 1024
SLACK = 0.001


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[int]:
    """The shard of the next virtual node clockwise from each cell."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            spot = int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:8], "big") % cells
            at[spot] = min(shard, at.get(spot, shard))
    owner, out = at[min(at)], [0] * cells
    for cell in reversed(range(cells)):
        owner = at.get(cell, owner)
        out[cell] = owner
    return out


def place(loads: list[tuple[int, int]], owners: list[int], shards: int, capacity: float, taken: list[int]) -> list[int]:
    """The shard of each (cell, bytes), in order; ``taken`` has the bytes of each shard and is brought up to date."""
    out = []
    for cell, size in loads:
        seen: list[int] = []
        step = cell
        while len(seen) < shards and step < cell + len(owners):
            shard = owners[step % len(owners)]
            if shard not in seen:
                seen.append(shard)
                if taken[shard] + size <= capacity:
                    break
            step += 1
        else:
            shard = min(range(shards), key=lambda s: (taken[s], s))
        taken[shard] += size
        out.append(shard)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null: the law is
    ``bytes``). Other columns are left out."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    units = materialize(rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count("*").alias("m")), "units")
    key = ["g", "text_crc32", "size"]
    total = units.agg(F.sum(F.col("size") * F.col("m"))).first()[0] or 0
    capacity = total / shards * (1 + slack)
    keys = units.groupBy(*key).agg(F.sum(F.col("size") * F.col("m")).alias("bytes"))
    cell = F.pmod(F.xxhash64("g", "text_crc32"), F.lit(CELLS)).cast("int")
    heavy = keys.where(F.col("bytes") > capacity / 1000).select(*key, "bytes", cell.alias("cell")).collect()
    heavy.sort(key=lambda r: (-r.bytes, r.cell, r.g))
    owners, taken = ring(shards), [0] * shards
    whole = [r for r in heavy if r.bytes <= capacity]
    homes = place([(r.cell, r.bytes) for r in whole], owners, shards, capacity, taken)
    known = [(r.g, r.text_crc32, r.size, s) for r, s in zip(whole, homes, strict=True)] + [(r.g, r.text_crc32, r.size, -1) for r in heavy if r.bytes > capacity]
    heavy_table = spark.createDataFrame(known, "g long, text_crc32 long, size long, home int")
    placed = units.join(F.broadcast(heavy_table), key, "left")
    placed = placed.withColumn("cell", F.when(F.col("home") == -1, F.pmod(F.xxhash64("g", "text_crc32", "doc_id"), F.lit(CELLS)).cast("int")).otherwise(cell))
    light = placed.where("home IS NULL OR home = -1")
    loads = {r.cell: r.bytes for r in light.groupBy("cell").agg(F.sum(F.col("size") * F.col("m")).alias("bytes")).collect()}
    order = sorted(loads)
    by_cell = dict(zip(order, place([(c, loads[c]) for c in order], owners, shards, capacity, taken), strict=True))
    table = F.split(F.lit(",".join(str(by_cell.get(c, owners[c])) for c in range(CELLS))), ",")
    placed = placed.withColumn("shard", F.when(F.col("home") >= 0, F.col("home")).otherwise(F.element_at(table, F.col("cell") + 1).cast("int")))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "g", "text_crc32", F.lit(5)), F.lit(BUCKETS)).cast("int")).select("doc_id", "size", "text_crc32", "g", "m", "shard", "bucket")
    counts = placed.groupBy("shard", "bucket").agg(F.sum("m").alias("c"))
    begins = counts.select("shard", "bucket", (F.sum("c").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("c")).alias("begin"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "g", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.join(F.broadcast(begins), ["shard", "bucket"]).withColumn("last", F.col("begin") + F.sum("m").over(inside))
    one = numbered.withColumn("back", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return one.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("last") - F.col("back")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
