"""Suffix-array dedup: common-prefix-aware distributed merge sort of text suffixes.

A byte goes if a string of 100 bytes that covers it also starts earlier. Every such window has an anchor, the
least hashed 24-gram inside, which copies of the window have at the same place; neighbouring windows share one.
So a sparse suffix array, with the suffix at each anchor and the bytes left of it, holds all repeats.

1. Texts are dealt into chunks by doc_id, in order of doc_id. Every chunk sends the hashes of its anchors' first
   24 bytes with counts; only prefixes that occur again anywhere can start a repeat (as in prefix-doubling string
   sorting, where duplicate detection by hash keeps all other suffixes at home).
2. The other suffixes are sorted in each chunk and sent as front-coded runs, dealt by that prefix. Of equal ones in
   a chunk only the first travels, the later ones are repeats for sure. For prefixes above ``HOT`` occurrences
   single windows travel, dealt by their whole content, so that no task gets all of a frequent passage's borders.
3. A loser tree merges the runs; it knows each suffix's common prefix with the last winner and never compares those
   bytes again. Suffixes in one anchor group lie together; the first start of each window wins.
4. Each chunk gets its repeats back and cuts them out.

Null texts are empty. Rows of equal doc_id count in order of their text, rows without doc_id last; rows equal in
both count as one after the other. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import arrow_pass, partitions
from patchloom.llm.textbytes import BASE, MIX_1, MIX_2, byte_view, mix, runs, sums

WINDOW, GRAM = 100, 24
#: Occurrences of an anchor's prefix above which single windows travel.
HOT = 5000
#: Window starts looked at together; their number fits the bits that break ties by place.
PIECE, PLACE_BITS = 1 << 20, np.uint64(24)


class Chunk:
    """The texts of a chunk in order, as one byte array."""

    def __init__(self, table: pa.Table):
        data, offsets = byte_view(table.column("text"))
        ids = table.column("doc_id").to_pylist()
        texts = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.ordinal = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            if self.ids[i] == self.ids[i - 1]:
                self.ordinal[i] = self.ordinal[i - 1] + 1
        self.text = b"".join(texts[i] for i in order)
        self.data = np.frombuffer(self.text, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in order], dtype=np.int64)]).astype(np.int64)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of window starts with one anchor: first start, last start, anchor."""
        valid = np.zeros(len(self.data), bool)
        for a, b in zip(self.offsets, self.offsets[1:], strict=False):
            valid[a : max(a, b - WINDOW + 1)] = True
        out = []
        for at in range(0, max(0, len(self.data) - WINDOW + 1), PIECE):
            starts = min(PIECE, len(self.data) - WINDOW + 1 - at)
            least = grams(self.data[at : at + starts + WINDOW - 1])
            least = (least >> PLACE_BITS << PLACE_BITS) | np.arange(len(least)).astype(np.uint64)
            span = 1
            while span * 2 <= WINDOW - GRAM + 1:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            rest = WINDOW - GRAM + 1 - span
            least = np.minimum(least[: len(least) - rest], least[rest:])
            anchor = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64) + at
            ok = valid[at : at + starts]
            new = ok.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
            ends = ok.copy()
            ends[:-1] &= (anchor[1:] != anchor[:-1]) | ~ok[1:]
            first = np.flatnonzero(new)
            out.append((first + at, np.flatnonzero(ends) + at, anchor[first]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the 24 bytes from each place on."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).copy()
    n = len(data) - GRAM + 1
    return mix(eight[:n] * BASE + mix(eight[8 : 8 + n] * MIX_1 + eight[16 : 16 + n] * MIX_2))


def anchor_hash(chunk: Chunk, anchors: np.ndarray) -> np.ndarray:
    if not len(anchors):
        return np.zeros(0, np.uint64)
    at = np.ndarray((len(chunk.data) - 7,), "<u8", chunk.text, strides=(1,))
    return mix(at[anchors] * BASE + mix(at[anchors + 8] * MIX_1 + at[anchors + 16] * MIX_2))


def packed(*values) -> bytes:
    raw = pickle.dumps(values, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Common prefix with the one before, length, and the remaining bytes of sorted suffixes."""
    shared = [0, *(common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))][: len(suffixes)]
    return np.array(shared, np.uint8), np.array([len(s) for s in suffixes], np.uint8), b"".join(s[k:] for s, k in zip(suffixes, shared, strict=True))


def decoded(shared: np.ndarray, lengths: np.ndarray, rest: bytes) -> Iterator[tuple[bytes, int]]:
    last, at = b"", 0
    for k, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        last = last[:k] + rest[at : at + n - k]
        at += n - k
        yield last, k


def merged(sorted_runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Loser tree over runs of (suffix, common prefix with the one before in its run).

    Yields (suffix, common prefix with the one yielded before, run, number in the run). A player's known prefix is
    that with the last winner: of two, the longer one is the lesser; only if equal, bytes beyond it are compared.
    """
    runs_ = len(sorted_runs)
    size = 1 << max(0, (runs_ - 1).bit_length())
    suffix: list[bytes | None] = [None] * size
    known, number = [0] * size, [0] * size
    for i, run in enumerate(sorted_runs):
        suffix[i], known[i] = next(run, (None, 0))[0], 0
    loser = [0] * size

    def lesser(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        x, y = suffix[a], suffix[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k = known[a]
        k += common(x[k:], y[k:])
        if len(x) == k and (len(y) > k or a < b) or len(x) > k and len(y) > k and x[k] < y[k]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    winners = [0] * (2 * size)
    winners[size:] = range(size)
    for node in range(size - 1, 0, -1):
        winners[node], loser[node] = lesser(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while suffix[top] is not None:
        yield suffix[top], known[top], top, number[top]
        following = next(sorted_runs[top], None)
        number[top] += 1
        suffix[top], known[top] = following if following else (None, 0)
        node, now = (size + top) // 2, top
        while node:
            now, loser[node] = lesser(now, loser[node])
            node //= 2
        top = now


def _runs_of(chunk: Chunk, known: pa.Table, n_parts: int, pid: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted runs by part, and the repeats that the chunk sees itself (part below 0)."""
    first, last, anchor = chunk.stretches()
    keys = [unpacked(x) for x in known.column("blob").to_pylist()]
    again = np.concatenate([k for k, _ in keys]) if keys else np.zeros(0, np.uint64)
    hot = np.concatenate([h for _, h in keys]) if keys else np.zeros(0, bool)
    order = np.argsort(again)
    again, hot = again[order], hot[order]
    h = anchor_hash(chunk, anchor)
    at = np.minimum(np.searchsorted(again, h), max(len(again) - 1, 0))
    found = np.flatnonzero(again[at] == h) if len(again) else np.zeros(0, np.int64)
    doc = np.searchsorted(chunk.offsets, first, "right") - 1
    seen: set[tuple[bytes, int]] = set()
    parts: dict[int, list] = defaultdict(list)
    later: list[tuple[int, int, int]] = []
    text = chunk.text
    for i, is_hot in zip(found.tolist(), hot[at[found]].tolist(), strict=True):
        a, b, c, d = int(first[i]), int(last[i]), int(anchor[i]), int(doc[i])
        begin = int(chunk.offsets[d])
        for s, e, place in ((s, s, s) for s in range(a, b + 1)) if is_hot else ((a, b, c),):
            whole = text[s : e + WINDOW]
            if (whole, place - s) in seen:
                later.append((d, s - begin, e - begin))
                continue
            seen.add((whole, place - s))
            part = zlib.crc32(whole) if is_hot else int(h[i])
            parts[part % n_parts].append((whole[place - s :], whole[: place - s], d, s - begin))
    if later:
        yield -1 - pid, pid, packed(np.array(later, np.int64))
    for part, entries in parts.items():
        entries.sort()
        shared, lengths, rest = front_coded([x[0] for x in entries])
        d = np.array([x[2] for x in entries], np.int64)
        ids = [chunk.ids[i] for i in d]
        none = np.array([x is None for x in ids])
        yield part, pid, packed(shared, lengths, rest, np.array([len(x[1]) for x in entries], np.uint8), b"".join(x[1] for x in entries), none, np.array([x or 0 for x in ids], np.int64), chunk.ordinal[d], d, np.array([x[3] for x in entries], np.int64))


def repeats(group: list[tuple[bytes, bytes, tuple, int]]) -> Iterator[tuple[int, int, int]]:
    """Of entries (suffix, bytes before, (…, start) for the order, owner) the repeated window starts: owner, first, last."""
    group.sort(key=lambda x: x[2])
    wholes: set[tuple[bytes, int]] = set()
    windows: set[bytes] = set()
    for suffix, before, order, owner in group:
        text, start = before + suffix, order[-1]
        n = len(text) - WINDOW + 1
        if (text, len(before)) in wholes:
            yield owner, start, start + n - 1
            continue
        wholes.add((text, len(before)))
        run = -1
        for i in range(n):
            window = text[i : i + WINDOW]
            if window in windows:
                run = i if run < 0 else run
            else:
                windows.add(window)
                if run >= 0:
                    yield owner, start + run, start + i - 1
                    run = -1
        if run >= 0:
            yield owner, start + run, start + n - 1


def _merge_part(blobs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Repeats by chunk from the sorted runs of one part."""
    loaded = [unpacked(blob) for _, blob in blobs]
    before = []
    for x in loaded:
        ends = np.cumsum(x[3].astype(np.int64))
        before.append([x[4][b - n : b] for b, n in zip(ends.tolist(), x[3].tolist(), strict=True)])
    found: dict[int, list] = defaultdict(list)
    group: list = []

    def close():
        if len(group) > 1:
            for (run, i), s, e in repeats(group):
                found[run].append((int(loaded[run][8][i]), s, e))
        group.clear()

    for suffix, shared, run, i in merged([decoded(x[0], x[1], x[2]) for x in loaded]):
        if shared < GRAM:
            close()
        x = loaded[run]
        group.append((suffix, before[run][i], (bool(x[5][i]), int(x[6][i]), int(x[7][i]), int(x[9][i])), (run, i)))
    close()
    by_chunk: dict[int, list] = defaultdict(list)
    for run, rows in found.items():
        by_chunk[blobs[run][0]] += rows
    for pid, rows in by_chunk.items():
        yield pid, packed(np.array(rows, np.int64))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(part, [(pid, blob)]) from rows sorted by part."""
    part, held = None, []
    for batch in batches:
        for now, pid, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != part and held:
                yield part, held
                held = []
            part = now
            held.append((pid, blob))
    if held:
        yield part, held


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, starts and ends of the removed runs, and the ``kept`` bytes."""
    spark = docs.sparkSession
    n = partitions(spark)
    parts = n
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("pid", F.pmod(F.xxhash64("doc_id"), F.lit(2 * n)).cast("int"))
    texts = texts.repartition(n, "pid")
    schema = "part int, pid int, blob binary"

    def prefixes(pid: int, table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        chunk = Chunk(table)
        h, c = np.unique(anchor_hash(chunk, chunk.stretches()[2]), return_counts=True)
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        borders = np.searchsorted(part[order], np.arange(parts + 1))
        for i in range(parts):
            at = order[borders[i] : borders[i + 1]]
            if len(at):
                yield i, pid, packed(h[at], c[at].astype(np.uint32))

    def rows(items) -> pa.Table:
        items = list(items)
        return pa.table({"part": pa.array([x[0] for x in items], pa.int32()), "pid": pa.array([x[1] for x in items], pa.int32()), "blob": pa.array([x[2] for x in items], pa.binary())})

    def occurring_again(batches):
        for _, held in _by_part(batches):
            loaded = [unpacked(x) for _, x in held]
            h, c = np.concatenate([x[0] for x in loaded]), np.concatenate([x[1] for x in loaded])
            names, place = np.unique(h, return_inverse=True)
            total = np.bincount(place, c, len(names))[place]
            ends = np.cumsum([len(x[0]) for x in loaded])
            out = []
            for (pid, _), e, x in zip(held, ends, loaded, strict=True):
                t = total[e - len(x[0]) : e]
                if (t > 1).any():
                    out.append((pid, packed(x[0][t > 1], t[t > 1] > HOT)))
            yield {"pid": [x[0] for x in out], "blob": [x[1] for x in out]}

    def merge(batches):
        for part, held in _by_part(batches):
            out = held if part < 0 else list(_merge_part(held))
            yield {"pid": [x[0] for x in out], "blob": [x[1] for x in out]}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        change = np.zeros(len(chunk.data) + 1, np.int32)
        for blob in right.column("blob").to_pylist():
            doc, s, e = unpacked(blob)[0].T
            np.add.at(change, chunk.offsets[doc] + s, 1)
            np.add.at(change, chunk.offsets[doc] + e + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        a, b = runs(gone, chunk.offsets)
        borders = np.searchsorted(a, chunk.offsets)
        removed, sizes = sums(gone, chunk.offsets), np.diff(chunk.offsets)
        ends = np.concatenate([[0], np.cumsum(sizes - removed)])
        kept = chunk.data[~gone].tobytes()
        begin = np.repeat(chunk.offsets[:-1], np.diff(borders))
        list_of = lambda x: pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(x, pa.int64()))
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(borders), pa.int64()),
            "starts": list_of(a - begin), "ends": list_of(b - begin), "kept": pa.array([kept[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary()),
        })

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(n, "part").sortWithinPartitions("part")

    sent = texts.groupBy("pid").applyInArrow(lambda key, t: rows(prefixes(key[0].as_py(), t)), schema)
    again = arrow_pass(dealt(sent), "pid int, blob binary", occurring_again)
    by_chunk = lambda df: texts.groupBy("pid").cogroup(df.groupBy("pid"))
    sorted_runs = by_chunk(again).applyInArrow(lambda left, right: rows(_runs_of(Chunk(left), right, parts, left.column("pid")[0].as_py())) if left.num_rows else rows([]), schema)
    found = arrow_pass(dealt(sorted_runs), "pid int, blob binary", merge)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary"
    return by_chunk(found).applyInArrow(cut, result)
