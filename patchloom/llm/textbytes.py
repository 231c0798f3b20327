"""Vectorised word and line boundaries over Arrow text columns, as bytes.

Texts of one slice lie behind each other in one byte array; no word, line or window crosses from
one text into the next. A slice holds about a megabyte, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# Odd multipliers of the hashes (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null counts as empty) and where each text begins; one more entry is the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()), "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have ``limit`` bytes together, or one row with more."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 … n-1 modulo 2^64."""
    if len(_POWERS[0]) < n:
        table = np.full(max(n, 1024), BASE, np.uint64)
        table[0] = 1
        _POWERS[0] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[0][:n]


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``data[start : start + length]``; equal bytes give equal hashes."""
    out = np.zeros(len(starts), np.uint64)
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    ends, found, at = np.cumsum(lengths), [], 0
    while at < len(starts):  # some megabytes at once
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        begin, length = starts[at:stop], lengths[at:stop]
        firsts = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(firsts, length)
        values = (data[np.repeat(begin, length) + within].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[within]
        found.append(mix(np.add.reduceat(values, firsts) + length.astype(np.uint64) * MIX_2))
        at = stop
    if found:
        out[some] = np.concatenate(found)
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the text borders ``offsets``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice: ``start``, ``end``, ``doc`` and the 64-bit ``key`` of each,
    and ``first``: the number of the first word of each text (one more entry is the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.start, self.end = runs(~SPACE[data], offsets)
        self.first = np.searchsorted(self.start, offsets, "left")
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.key = hash_runs(self.data, self.start, self.end - self.start)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit hash of each window of ``size`` words that lies in one text, and its first word."""
        n = len(self.key) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total = mix(total * BASE + self.key[i : i + n])
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return total[at], at


def sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``borders``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[borders[1:]] - total[borders[:-1]]
