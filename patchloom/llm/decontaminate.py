"""Benchmark decontamination: Wu-Manber multi-pattern search for word windows of benchmark items.

A window of an item is searched as text: words in lower case with one space before and after each. Patterns
are searched by classes of similar length. In a class, a shift table by text block says how far the search
may jump; where it says 0, the bucket of the block has the strings to test, and a direct comparison confirms.

The benchmark is a stated query set and is met in blocks of at most ``BLOCK_WINDOWS`` windows (or one item);
every task meets all blocks, one at a time. Items of the same id are one item; an item without id marks words
but is in no list. Null and empty texts have no words. Empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm.tables import arrow_pass
from patchloom.llm.textbytes import LOWER

WINDOW = 10
BLOCK_WINDOWS = 20_000
#: Longest text block of a shift table.
BLOCK_BYTES = 8

# Word bytes stay (A-Z in lower case), all others become a space.
WORD_BYTES = bytes(int(LOWER[b]) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def spaced(text: str | None) -> bytes:
    """The words of a text with one space before and after each; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    return b" %b " % b" ".join(words) if words else b""


def item_windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    words = spaced(text).split()
    return {b" %b " % b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Patterns:
    """The tables of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.least = min(map(len, patterns))
        self.block = min(self.least, BLOCK_BYTES)
        self.most = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, self.least + 1):
                part = p[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.most), self.least - end)
            self.bucket[p[self.least - self.block : self.least]][p[: self.least]].append(p)

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """All (position, pattern), in order of position."""
        found, shift, block, least, most = [], self.shift.get, self.block, self.least, self.most
        end, n = least, len(text)
        while end <= n:
            part = text[end - block : end]
            step = shift(part, most)
            if step:
                end += step
                continue
            start = end - least
            found += [(start, p) for p in self.bucket[part].get(text[start:end], ()) if text.startswith(p, start)]
            end += 1
        return found


class Searcher:
    """A block of items: its windows by length class and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        self.owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for window in item_windows(text, size):
                self.owners[window].add(item)
        classes = defaultdict(list)
        for window in self.owners:
            classes[len(window).bit_length()].append(window)
        self.classes = [Patterns(x) for x in classes.values()]

    def hits(self, text: bytes) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of the occurrences in a ``spaced`` text, and their items."""
        ranges, items = [], set()
        for patterns in self.classes:
            for start, p in patterns.search(text):
                word = text.count(b" ", 0, start)
                ranges.append((word, word + p.count(b" ") - 1))
                items |= self.owners[p]
        return ranges, items


def covered(ranges: list[tuple[int, int]]) -> int:
    total = done = 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, done))
        done = max(done, b)
    return total


_KEPT: dict[str, Searcher] = {}
_RUN = count()


def item_blocks(benchmark: DataFrame, size: int = WINDOW) -> list:
    """The items in broadcast blocks of bounded size, read to the driver one after the other."""
    context = benchmark.sparkSession.sparkContext
    blocks, rows, n = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        more = max(1, len(spaced(r[1]).split()) - size + 1)
        if rows and n + more > BLOCK_WINDOWS:
            blocks.append(context.broadcast((f"{context.applicationId}-{next(_RUN)}", rows)))
            rows, n = [], 0
        rows.append((r[0], r[1]))
        n += more
    return [*blocks, context.broadcast((f"{context.applicationId}-{next(_RUN)}", rows))] if rows else blocks


def searcher(block, size: int) -> Searcher:
    """The tables of a block, built once per Python worker; only one block's tables are held."""
    name, rows = block.value
    if (name, size) not in _KEPT:
        _KEPT.clear()
        _KEPT[name, size] = Searcher(rows, size)
    return _KEPT[name, size]


def hits_of(texts: list[str | None], blocks: list, size: int) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, sorted items) of each text."""
    forms = [spaced(t) for t in texts]
    ranges, items = [[] for _ in forms], [set() for _ in forms]
    for block in blocks:
        find = searcher(block, size).hits
        for i, form in enumerate(forms):
            a, b = find(form)
            ranges[i] += a
            items[i] |= b
    return [(max(0, f.count(b" ") - 1), covered(r), sorted(x - {None})) for f, r, x in zip(forms, ranges, items, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = WINDOW) -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, items (sorted as strings), n_items, items_sha256, contaminated."""
    blocks = item_blocks(benchmark, size)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean").fields])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = hits_of(part.column(part.num_columns - 1).to_pylist(), blocks, size)
                yield {c: part.column(i) for i, c in enumerate(keep)} | {
                    "n_words": [x[0] for x in found], "n_hit": [x[1] for x in found], "n_items": [len(x[2]) for x in found], "items": [x[2] for x in found],
                    "items_sha256": [hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in found], "contaminated": [x[1] > 0 for x in found],
                }

    return arrow_pass(rows, schema, work)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns."""
    blocks = item_blocks(benchmark, size)
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = hits_of(part.column(at).to_pylist(), blocks, size)
                yield part.filter(pa.array(np.array([not x[1] for x in found], bool)))

    return arrow_pass(docs, docs.schema, work)
