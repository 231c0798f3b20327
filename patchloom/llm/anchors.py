"""Substring dedup with fixed-block anchors.

A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id. Every window
holds a whole block of 25 words of its document's fixed grid. So the blocks of all documents are the index, the rolling
25-word windows of all documents are the probes, and a repeat is found from a hit by extending it to both sides; what
reaches further than 25 words to a side lies in the next block's hits.

1. Texts are dealt into chunks of about ``CHUNK_BYTES``, by doc_id and text. A chunk sends the first bits of each distinct
   window hash once, marked where it is a block, and each block with a hash of its surroundings. Only windows that look
   like a block somewhere and occur again are probed further (by their whole hashes); all others stay at home.
2. A chunk sends each such block with the 25 words to both sides, one of equal ones (that of the least doc_id), and
   asks for the hashes that its windows hit. Every asking chunk gets the distinct surroundings of the block.
3. In the chunk hits are extended word by word to maximal exact repeats, compared once more as text, and cut out.

A block in the middle of a passage that very many documents hold has as many surroundings as documents. Beyond ``HOT``
of them its windows of 50 words travel instead, as 128-bit hashes with the least doc_id, each at most once a chunk.

Null and empty texts have no words. Rows without doc_id come after all others, and none of them before another. Rows of
one doc_id do not repeat each other; equal rows are judged alike. Texts of any length count whole. An empty table gives
an empty result. doc_id is read as a whole number; other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.suffixes import packed, unpacked
from patchloom.llm.tables import arrow_pass, materialize, partitions
from patchloom.llm.textbytes import MIX_1, MIX_2, Words, byte_view, mix, powers

WINDOW, BLOCK = 50, 25
#: Words to each side of a block that an extension may need.
SIDE = WINDOW - BLOCK
#: Distinct surroundings of a block above which its windows travel as hashes.
HOT = 64
#: Bytes of text per chunk, and hits extended together.
CHUNK_BYTES, PIECE = 16 << 20, 1 << 16
LAST = np.iinfo(np.int64).max
ONE, TWO, THREE = np.uint64(1), np.uint64(2), np.uint64(3)


def running(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Sums of the salted keys times powers, from the first key to each place."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ salt) * powers(max(len(keys), 1))[: len(keys)], dtype=np.uint64)])


_INVERSE = [np.ones(1, np.uint64)]


def inverse_powers(n: int) -> np.ndarray:
    """What undoes ``powers`` (an odd base has an inverse)."""
    if len(_INVERSE[0]) < n:
        table = np.full(max(n, 1024), pow(int(powers(2)[1]), -1, 1 << 64), np.uint64)
        table[0] = 1
        _INVERSE[0] = np.cumprod(table, dtype=np.uint64)
    return _INVERSE[0][:n]


def spans(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the keys from ``a`` to ``b``, wherever they lie."""
    return mix((total[b] - total[a]) * inverse_powers(len(total))[a] + (b - a).astype(np.uint64) * MIX_2)


class Chunk:
    """The words of a chunk's texts, in order of doc_id and text."""

    def __init__(self, table: pa.Table):
        self.table = table
        data, offsets = byte_view(table.column("text"))
        self.words = Words(data, offsets)
        self.first = self.words.first
        ids = table.column("doc_id")
        self.none = ids.is_null().to_numpy()
        self.doc_id = np.where(self.none, LAST, ids.fill_null(0).to_numpy())
        keys = self.words.key
        doc = self.words.doc
        self.total = running(keys, MIX_1)
        begin = np.arange(max(0, len(keys) - BLOCK + 1))
        self.window = spans(self.total, begin, begin + BLOCK)
        self.inside = doc[: len(self.window)] == doc[BLOCK - 1 :] if len(self.window) else np.zeros(0, bool)
        place = np.arange(len(self.window)) - self.first[doc[: len(self.window)]]
        self.block = self.inside & (place % BLOCK == 0)

    def normal(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words behind each other with one space after each, and where each begins and ends."""
        w = self.words
        size = w.end - w.start
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        runs = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + runs] = w.data[np.repeat(w.start, size) + runs]
        return out.tobytes(), begin, begin + size

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the surroundings of the blocks at ``at``, cut at the text's borders."""
        doc = self.words.doc[at]
        return np.maximum(at - SIDE, self.first[doc]), np.minimum(at + BLOCK + SIDE, self.first[doc + 1])

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """A hash of the surroundings of each block."""
        a, b = self.around(at)
        return mix(spans(self.total, a, b) + (at - a).astype(np.uint64))

    def short(self, bits: int) -> np.ndarray:
        """The first bits of each window's hash, in front of two free bits for marks."""
        return self.window >> np.uint64(64 - bits) << TWO


def _parted(keys: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions) of keys of so many bits; parts are ranges of keys."""
    low = keys >> np.uint64(bits - 24) if bits > 24 else keys << np.uint64(24 - bits)
    part = (low * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    borders = np.searchsorted(part[order], np.arange(parts + 1))
    for i in range(parts):
        if borders[i] < borders[i + 1]:
            yield i, order[borders[i] : borders[i + 1]]


def dense(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: their high bytes are mostly zero and pack well."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def undense(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def offered(chunk: Chunk, bits: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """Per part: the distinct window hashes, marked 1 if a block and 2 if found again in the chunk, and the blocks' surroundings."""
    h = chunk.short(bits)
    names, count = np.unique(h[chunk.inside], return_counts=True)
    at = np.flatnonzero(chunk.block)
    is_block = np.zeros(len(names), bool)
    is_block[np.searchsorted(names, h[at])] = True
    marked = names | is_block.astype(np.uint64) | ((count > 1).astype(np.uint64) << ONE)
    pairs = np.unique(np.stack([h[at], chunk.surroundings(at) >> np.uint64(32)], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
    blocks = dict(_parted(pairs[:, 0], bits + 2, parts))
    for part, where in _parted(marked, bits + 2, parts):
        some = blocks.get(part, np.zeros(0, np.int64))
        yield part, packed(dense(marked[where]), dense(pairs[some, 0]), pairs[some, 1].astype(np.uint32).tobytes())


def wanted(held: list[tuple[int, bytes]], limit: int) -> Iterator[tuple[int, bytes]]:
    """Per chunk: its hashes that are a block somewhere and occur again; marked 1 if they have too many surroundings."""
    loaded = [unpacked(x) for _, x in held]
    keys = [undense(x[0]) for x in loaded]
    every = np.concatenate(keys)
    names, place = np.unique(every >> TWO, return_inverse=True)
    blocks = np.bincount(place, (every & ONE).astype(float), len(names)) > 0
    again = np.bincount(place, 1.0 + ((every & TWO) > 0), len(names)) > 1
    around = np.unique(np.stack([np.concatenate([undense(x[1]) for x in loaded]), np.concatenate([np.frombuffer(x[2], np.uint32) for x in loaded]).astype(np.uint64)], axis=1), axis=0)
    hot = np.bincount(np.searchsorted(names, around[:, 0] >> TWO), minlength=len(names)) > limit
    good = blocks & again
    at = 0
    for (pid, _), own in zip(held, keys, strict=True):
        mine = place[at : at + len(own)]
        at += len(own)
        keep = good[mine]
        if keep.any():
            yield pid, packed(dense((own[keep] & ~THREE) | hot[mine[keep]].astype(np.uint64)))


class Hits:
    """The windows of a chunk that hit the index: where they begin, their hash, and whether the block is hot."""

    def __init__(self, chunk: Chunk, bits: int, blobs: list[bytes]):
        keys = [undense(unpacked(x)[0]) for x in blobs]
        known = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        names = known & ~THREE
        h = chunk.short(bits)
        at = np.minimum(np.searchsorted(names, h), max(len(names) - 1, 0))
        found = chunk.inside & (names[at] == h) if len(names) else np.zeros(len(h), bool)
        self.at = np.flatnonzero(found)
        self.key = chunk.window[self.at]
        self.hot = (known[at[self.at]] & ONE) > 0 if len(names) else np.zeros(0, bool)

    def hot_windows(self, chunk: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the 50-word windows that hold a window at ``at``, and two hashes of each."""
        doc = chunk.words.doc
        near = np.zeros(len(doc) + 1, np.int32)
        np.add.at(near, np.maximum(at - SIDE, 0), 1)
        np.add.at(near, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(near[:-1])[: max(0, len(doc) - WINDOW + 1)] > 0)
        starts = starts[doc[starts] == doc[starts + WINDOW - 1]]
        return starts, spans(chunk.total, starts, starts + WINDOW), spans(running(chunk.words.key, MIX_2), starts, starts + WINDOW)


def indexed(chunk: Chunk, hits: Hits, parts: int) -> Iterator[tuple[int, bytes]]:
    """Per part: blocks with surroundings (hash, doc_id, words to the left, text), hashes asked for, hot windows and hot questions."""
    out: dict[int, list] = defaultdict(lambda: [None] * 4)
    is_block = chunk.block[hits.at]
    cold = hits.at[is_block & ~hits.hot]
    if len(cold):
        key, h = chunk.window[cold], chunk.surroundings(cold)
        doc = chunk.doc_id[chunk.words.doc[cold]]
        order = np.lexsort((doc, h, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1])
        cold, key, doc = cold[order][new], key[order][new], doc[order][new]
        text, begin, end = chunk.normal()
        a, b = chunk.around(cold)
        for part, where in _parted(key, 64, parts):
            out[part][0] = key[where].tobytes(), doc[where].tobytes(), (cold[where] - a[where]).astype(np.uint8).tobytes(), [text[begin[i] : end[j - 1]] for i, j in zip(a[where].tolist(), b[where].tolist(), strict=True)]
    asked = np.unique(hits.key[~hits.hot])
    highest = np.zeros(len(asked), np.int64)
    if len(asked):
        highest = np.full(len(asked), np.iinfo(np.int64).min)
        np.maximum.at(highest, np.searchsorted(asked, hits.key[~hits.hot]), chunk.doc_id[chunk.words.doc[hits.at[~hits.hot]]])
    for part, where in _parted(asked, 64, parts):
        out[part][1] = asked[where].tobytes(), highest[where].tobytes()
    for slot, at in ((2, hits.at[is_block & hits.hot]), (3, hits.at[hits.hot])):
        starts, h, g = hits.hot_windows(chunk, at)
        doc = chunk.doc_id[chunk.words.doc[starts]] if len(starts) else np.zeros(0, np.int64)
        order = np.lexsort((doc if slot == 2 else -doc, g, h))
        h, g, doc = h[order], g[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        h, g, doc = h[new], g[new], doc[new]
        for part, where in _parted(h, 64, parts):
            out[part][slot] = h[where].tobytes(), g[where].tobytes(), doc[where].tobytes()
    for part, four in out.items():
        yield part, packed(*four)


def answered(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Per chunk: the surroundings of the blocks that it asked for and hot windows, of smaller doc_ids than its own largest."""
    loaded = [unpacked(x) for _, x in held]
    entries: dict[int, dict[tuple[int, bytes], int]] = defaultdict(dict)
    windows: dict[tuple[int, int], int] = {}
    as_ints = lambda raw, kind=np.uint64: np.frombuffer(raw, kind).tolist()
    for blocks, _, hot, _ in loaded:
        if blocks:
            for key, doc, left, text in zip(as_ints(blocks[0]), as_ints(blocks[1], np.int64), as_ints(blocks[2], np.uint8), blocks[3], strict=True):
                mine = entries[key]
                if mine.get((left, text), LAST) >= doc:
                    mine[left, text] = doc
        if hot:
            for h, g, doc in zip(as_ints(hot[0]), as_ints(hot[1]), as_ints(hot[2], np.int64), strict=True):
                if windows.get((h, g), LAST) >= doc:
                    windows[h, g] = doc
    for (pid, _), (_, asked, _, hot) in zip(held, loaded, strict=True):
        rows = []
        if asked:
            for key, highest in zip(as_ints(asked[0]), as_ints(asked[1], np.int64), strict=True):
                rows += [(key, doc, left, text) for (left, text), doc in entries.get(key, {}).items() if doc < highest]
        found = []
        if hot:
            for h, g, highest in zip(as_ints(hot[0]), as_ints(hot[1]), as_ints(hot[2], np.int64), strict=True):
                doc = windows.get((h, g), LAST)
                if doc < highest:
                    found.append((h, g, doc))
        if rows or found:
            yield pid, packed(
                np.array([x[0] for x in rows], np.uint64), np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64), [x[3] for x in rows],
                np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.uint64), np.array([x[2] for x in found], np.int64),
            )


def extended(chunk: Chunk, hits: Hits, key: np.ndarray, doc: np.ndarray, left: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first words, ends) of the repeats: hits on the blocks (hash, doc_id, words to the left, text), extended to both sides as
    far as the words agree (by 64-bit hashes), and then compared as text."""
    order = np.argsort(key, kind="stable")
    key, doc, left, texts = key[order], doc[order], left[order], [texts[i] for i in order.tolist()]
    column = pa.array(texts, pa.large_binary())
    raw, offsets = byte_view(column)
    ref, whole = Words(raw, offsets), raw.tobytes()
    text, begin, end = chunk.normal()
    own, words_doc = chunk.words.key, chunk.words.doc
    low, high = np.searchsorted(key, hits.key, "left"), np.searchsorted(key, hits.key, "right")
    bounds = np.concatenate([[0], np.cumsum(high - low)])
    at = 0
    while at < len(low):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
        count = (high - low)[at:stop]
        hit = np.repeat(hits.at[at:stop], count)
        entry = np.repeat(low[at:stop] - bounds[at:stop], count) + np.arange(bounds[at], bounds[stop])
        at = stop
        d = words_doc[hit]
        earlier = doc[entry] < chunk.doc_id[d]
        hit, entry, d = hit[earlier], entry[earlier], d[earlier]
        if not len(hit):
            continue
        anchor = ref.first[entry] + left[entry]
        reach = []
        for back, room in ((True, np.minimum(left[entry], hit - chunk.first[d])), (False, np.minimum(ref.first[entry + 1] - anchor, chunk.first[d + 1] - hit) - BLOCK)):
            far = np.zeros(len(hit), np.int64)
            going = np.flatnonzero(room > 0)
            for i in range(1, SIDE + 1):
                offset = -i if back else BLOCK + i - 1
                going = going[own[hit[going] + offset] == ref.key[anchor[going] + offset]]
                far[going] = i
                going = going[room[going] > i]
                if not len(going):
                    break
            reach.append(far)
        a, b = hit - reach[0], hit + BLOCK + reach[1]
        long = np.flatnonzero(b - a >= WINDOW)
        a, b, x, e = a[long], b[long], (anchor - reach[0])[long], entry[long]
        here = zip(begin[a].tolist(), end[b - 1].tolist(), ref.start[x].tolist(), ref.end[x + b - a - 1].tolist(), strict=True)
        same = np.fromiter((text[i:j] == whole[k:m] for i, j, k, m in here), bool, len(a))
        yield a[same], b[same]


def cut(chunk: Chunk, hits: Hits, answers: list[bytes]) -> pa.Table:
    change = np.zeros(len(chunk.words.key) + 1, np.int32)
    loaded = [unpacked(x) for x in answers]
    if loaded:
        key, doc, left, h, g, least = (np.concatenate([x[i] for x in loaded]) for i in (0, 1, 2, 4, 5, 6))
        for a, b in extended(chunk, hits, key, doc, left, [text for x in loaded for text in x[3]]):
            np.add.at(change, a, 1)
            np.add.at(change, b, -1)
        starts, own, other = hits.hot_windows(chunk, hits.at[hits.hot])
        order = np.lexsort((g, h))
        h, g, least = h[order], g[order], least[order]
        low, high = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
        owner = chunk.doc_id[chunk.words.doc[starts]]
        for step in range(int((high - low).max(initial=0))):  # more than one only if two windows share 64 bits
            e = np.minimum(low + step, max(len(h) - 1, 0))
            a = starts[(low + step < high) & (g[e] == other) & (least[e] < owner)]
            np.add.at(change, a, 1)
            np.add.at(change, a + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    text, begin, end = chunk.normal()
    keep = np.flatnonzero(~gone)
    sizes = np.diff(chunk.first)
    removed = np.concatenate([[0], np.cumsum(gone)])[chunk.first]
    kept_first = np.searchsorted(keep, chunk.first)
    kept = []
    for a, b in zip(kept_first.tolist(), kept_first[1:].tolist(), strict=False):
        if b - a and keep[b - 1] - keep[a] == b - a - 1:
            kept.append(text[begin[keep[a]] : end[keep[b - 1]]])
        else:
            kept.append(b" ".join([text[i:j] for i, j in zip(begin[keep[a:b]].tolist(), end[keep[a:b]].tolist(), strict=True)]))
    return pa.table({"doc_id": pa.array(chunk.doc_id, pa.int64(), mask=chunk.none), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """The (pid, blob) of each part from rows sorted by part."""
    part, held = None, []
    for batch in batches:
        for now, pid, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != part and held:
                yield held
                held = []
            part = now
            held.append((pid, blob))
    if held:
        yield held


def without_repeats(docs: DataFrame, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the ``kept`` words, joined by one space."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    chunks = max(2 * partitions(spark), -(-n_bytes // chunk_bytes))
    tasks = max(partitions(spark), chunks // 2)
    parts = tasks
    bits = min(62, 10 + max(16, int(n_bytes).bit_length()))  # one window in a thousand looks like another at any size
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dealt = F.pmod(F.xxhash64("doc_id", text, F.spark_partition_id()), F.lit(chunks)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), dealt.alias("pid")).repartition(tasks, "pid")
    schema = "part int, pid int, blob binary"

    def rows(items) -> pa.Table:
        items = list(items)
        return pa.table({"part": pa.array([x[0] for x in items], pa.int32()), "pid": pa.array([x[1] for x in items], pa.int32()), "blob": pa.array([x[2] for x in items], pa.binary())})

    def first(key, table):
        return rows((part, key[0].as_py(), blob) for part, blob in offered(Chunk(table), bits, parts))

    def second(left, right):
        if not left.num_rows or not right.num_rows:
            return rows([])
        chunk, pid = Chunk(left), left.column("pid")[0].as_py()
        return rows((part, pid, blob) for part, blob in indexed(chunk, Hits(chunk, bits, right.column("blob").to_pylist()), parts))

    def third(left, right):
        blobs = right.select(["kind", "blob"]).to_pylist()
        chunk = Chunk(left)
        hits = Hits(chunk, bits, [x["blob"] for x in blobs if x["kind"] == 0])
        return cut(chunk, hits, [x["blob"] for x in blobs if x["kind"] == 1])

    def each_part(work):
        def run(batches):
            for held in _by_part(batches):
                out = list(work(held))
                yield {"pid": [x[0] for x in out], "blob": [x[1] for x in out]}

        return run

    def by_parts(df: DataFrame, work) -> DataFrame:
        return arrow_pass(df.repartition(parts, "part").sortWithinPartitions("part", "pid"), "pid int, blob binary", each_part(work))

    def by_chunk(df: DataFrame, work, result: str) -> DataFrame:
        return texts.groupBy("pid").cogroup(df.groupBy("pid")).applyInArrow(work, result)

    again = materialize(by_parts(texts.groupBy("pid").applyInArrow(first, schema), lambda held: wanted(held, hot)), "wanted")
    answers = by_parts(by_chunk(again, second, schema), answered)
    both = again.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
    return by_chunk(both, third, "doc_id long, n_words long, n_removed long, kept string")
