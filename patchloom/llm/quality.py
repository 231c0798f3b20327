"""Quality rules: isolation forest over the statistics that quality rules look at.

Random splits cut the statistics of a bounded labelled sample into cells. A document that reaches a cell
without good rows after few splits is anomalous; the score above which it goes is chosen on all labelled rows.

Null or empty texts have no words and fail the base rules. Repeated rows are judged alike. Without labelled
rows of both kinds only the base rules decide. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm.tables import arrow_pass, materialize
from patchloom.llm.textbytes import BASE, Words, byte_view, hash_runs, mix, runs, slices, sums

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, rules array<float>"

#: Parameters of the forest: trees, sampled rows of a tree, bins of the calibration.
TREES, ROWS_PER_TREE, BINS = 64, 256, 1000
#: A wrongly rejected good document weighs as much as this many missed bad ones.
GOOD_WEIGHT = 10.0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flag = np.zeros(len(keys) + 1, bool)
    flag[1:-1] |= same
    flag[:-2] |= same
    out = np.zeros(len(keys), bool)
    out[order] = flag[:-1]
    return out


def later_repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text and the ratios that the forest looks at."""
    data, offsets = byte_view(column)
    words = Words(data, offsets)
    n = len(offsets) - 1
    salt = mix(np.arange(1, n + 1).astype(np.uint64) * BASE)
    n_words = np.diff(words.first)
    spaced = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = sums(spaced[words.end] - spaced[words.start], words.first)

    line_start, line_end = runs(data != 0x0A, offsets)
    holds_word = np.diff(np.searchsorted(words.start, np.stack([line_start, line_end]), "left"), axis=0)[0] > 0
    line_start, line_end = line_start[holds_word], line_end[holds_word]
    line_first = np.searchsorted(line_start, offsets, "left")
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    dup = later_repeats(hash_runs(data, line_start, line_end - line_start) ^ salt[line_doc])

    window, at = words.windows(3)
    again = at[repeated(window ^ salt[words.doc[at]])] if len(at) else at
    covered = np.zeros(len(words.key) + 1, bool)
    for i in range(3):
        covered[again + i] = True

    def per_text(mask: np.ndarray) -> np.ndarray:
        return sums(mask, offsets)

    out = dict(zip(COUNTS, (n_words, word_chars, per_text(SYMBOLS[data]), sums(dup, line_first), sums(covered[:-1], words.first)), strict=True))
    upper = per_text((data >= 0x41) & (data <= 0x5A))
    letters = upper + per_text((data >= 0x61) & (data <= 0x7A)) + per_text(data >= 0xC0)
    few = np.maximum(n_words, 1)
    ratios = [
        np.log1p(n_words), word_chars / few, out["n_symbols"] / few, out["n_dup_lines"] / np.maximum(np.diff(line_first), 1), out["n_repeat_words"] / few,
        upper / np.maximum(letters, 1), per_text(data == 0x21) / few, per_text((data >= 0x30) & (data <= 0x39)) / np.maximum(word_chars, 1), np.diff(line_first) / few,
    ]
    return out | {"ratios": np.stack(ratios, 1).astype(np.float32)}


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def rule_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with the counts and the ratios (``rules``) of each text."""
    kept = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], *T.StructType.fromDDL(STATS).fields])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "_text"):
                stats = statistics(part.column(part.num_columns - 1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * stats["ratios"].shape[1], pa.int32()), pa.array(stats["ratios"].ravel()))
                yield {c: part.column(i) for i, c in enumerate(keep)} | {c: stats[c] for c in COUNTS} | {"rules": flat}

    return arrow_pass(kept, schema, work)


def depth_left(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unfinished cell of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at a leaf), cut, left child (the right one follows), path length of a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float = 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over the usual path: near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                feature = self.feature[t][node]
                inner = feature >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(feature, 0)] >= self.cut[t][node]
                node = np.where(inner, self.left[t][node] + right, node)
            total += self.path[t][node]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.scale)


def grow(x: np.ndarray, good: np.ndarray, trees: int, per_tree: int, seed: int = 7) -> Forest:
    """Random splits over the range of all sampled rows; a cell ends with at most one good row."""
    rng = np.random.default_rng(seed)
    grown = []
    limit = int(np.ceil(np.log2(per_tree))) + 8
    for _ in range(trees):
        pick = rng.permutation(len(x))[:per_tree]
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, pick, 0)]
        while todo:
            node, rows, depth = todo.pop()
            n_good = int(good[rows].sum())
            low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            able = np.flatnonzero(high > low)
            if n_good <= 1 or depth >= limit or not len(able):
                path[node] = depth + float(depth_left(n_good))
                continue
            f = int(rng.choice(able))
            c = float(rng.uniform(low[f], high[f]))
            c = c if c > low[f] else float(high[f])
            feature[node], cut[node], left[node] = f, c, len(feature)
            feature += [-1, -1]
            cut += [0.0, 0.0]
            left += [0, 0]
            path += [0.0, 0.0]
            side = x[rows, f] >= c
            todo += [(left[node], rows[~side], depth + 1), (left[node] + 1, rows[side], depth + 1)]
        grown.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
    feature, cut, left, path = zip(*grown, strict=True)
    return Forest(feature, cut, left, path, max(float(depth_left(per_tree)), 1.0))


def fit_forest(stats: DataFrame, labels: DataFrame, trees: int = TREES, per_tree: int = ROWS_PER_TREE) -> Forest | None:
    """Grow the forest on at most ``trees * per_tree`` labelled rows that pass the base rules (those of the lowest hash
    of doc_id) and set the threshold on all labelled rows. If all of those are of one kind, as many of the other join them.
    None without labelled rows of both kinds.

    ``labels`` has doc_id and quality; of several labels of a document the lowest holds, null labels count as none.
    """
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    passes = "n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words"
    known = materialize(stats.where(passes).join(label, F.col("doc_id") == F.col("_id")).select("doc_id", "rules", F.col("_good").cast("int").alias("good")), "labelled")

    def first(rows: DataFrame) -> list:
        """The rows of the lowest hashes; a share of about twice as many is cut first, so that the tasks together send no more."""
        share = min(1.0, 2 * trees * per_tree / max(rows.count(), 1))
        cut = rows.where(F.xxhash64("doc_id") <= int(share * (2**64 - 1)) - 2**63) if share < 1 else rows
        return cut.orderBy(F.xxhash64("doc_id"), "rules").limit(trees * per_tree).collect()

    sample = first(known)
    kinds = {r.good > 0 for r in sample}
    if len(kinds) == 1:
        other = first(known.where("good <= 0" if True in kinds else "good > 0"))
        sample, kinds = sample + other, kinds | {r.good > 0 for r in other}
    if len(kinds) < 2:
        return None
    forest = grow(np.array([r.rules for r in sample], np.float32), np.array([r.good for r in sample]) > 0, trees, per_tree)

    def work(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield {"bin": np.minimum(forest.score(x) * BINS, BINS - 1).astype(int), "good": batch.column(1)}

    bins = arrow_pass(known.select("rules", "good"), "bin int, good int", work).groupBy("bin").agg(F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") > 0, 0).otherwise(1)).alias("bad"))
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in bins.collect():
        good[r.bin], bad[r.bin] = r.good, r.bad
    gain = np.cumsum((bad / max(bad.sum(), 1) - GOOD_WEIGHT * good / max(good.sum(), 1))[::-1])[::-1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    forest.threshold = float(best[0] + best[-1]) / 2 / BINS if gain.max() > 0 else 2.0
    return forest


def judged(stats: DataFrame, forest: Forest | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``anomaly`` and ``kept`` of each row of ``rule_statistics``."""
    rows = stats.select(*keep, *COUNTS, "rules")
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("base_failed boolean, anomaly double, kept boolean").fields])
    width = len(keep)

    def work(batches):
        for batch in batches:
            counts = {c: batch.column(width + i).to_numpy(zero_copy_only=False) for i, c in enumerate(COUNTS)}
            failed = base_failed(counts)
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            score = forest.score(x) if forest else np.zeros(batch.num_rows)
            yield {c: batch.column(i) for i, c in enumerate((*keep, *COUNTS))} | {"base_failed": failed, "anomaly": score, "kept": ~failed & (score < (forest.threshold if forest else 2.0))}

    return arrow_pass(rows, schema, work)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document with its counts, the base verdict, the anomaly score and whether it stays."""
    stats = materialize(rule_statistics(docs), "rules")
    return judged(stats, fit_forest(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; text goes through no shuffle."""
    forest = fit_forest(materialize(rule_statistics(docs), "rules"), labels)
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                stats = statistics(part.column(at))
                stays = ~base_failed(stats)
                if forest:
                    stays &= forest.score(stats["ratios"]) < forest.threshold
                yield part.filter(pa.array(stays))

    return arrow_pass(docs, docs.schema, work)
