"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, then exact intersection.

Each text has the set of its distinct word shingles (64-bit hashes). Equal sets are one node. Sizes fall into
bands so wide that linked sets lie in the same or the next one. For a band at most ``d`` elements can differ
between linked sets, so of their parts by hash at most d differ: a set with more than d filled parts shares a
filled part with each set that it links with. There are as many parts as fill d + 1 of them almost surely; a set
with fewer also cuts itself anew for each part that it lacks. A tile holds the sets that share a band and a part.

Candidates are met twice. First, neighbours within each tile are checked; verified links join components. Then
only tiles that still hold several components are compared, blocks against blocks: sizes and the differing bits
of the signatures bound the overlap from above. A pair that shares several tiles is looked at in the first of them.
Each block names the sets that may still link, gets their sorted arrays, intersects them exactly and gives a forest
of the links that join components: at most one link less than it has sets, however large a group is. Members of one
component aren't compared again, which loses no component.

Null and empty texts have no set, link with nothing and are their own component; a row without doc_id gets the
least doc_id of its component, or null. Repeated rows are links of equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.anchors import _parted, dense, undense
from patchloom.llm.components import components
from patchloom.llm.suffixes import packed, unpacked
from patchloom.llm.tables import arrow_pass, materialize, partitions, release
from patchloom.llm.textbytes import BASE, MIX_2, Words, byte_view, hash_runs, mix, slices, sums

#: Least bits of a signature (it has two to four for each element); sets of a block when tiles are compared.
BITS = 512
BLOCK = 2048
#: Bytes of text whose keys travel together, and of text per part of the keys.
UNIT_BYTES, PART_BYTES = 8 << 20, 64 << 20
#: A set's first tiles by which its pairs are told to have met before.
FIRST_TILES = 8
#: Bits of the filter that names the texts whose arrays are wanted: of fixed size, so that it may be sent to all.
FILTER_BITS = 1 << 23


def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each band, how many elements may differ between linked sets up to its largest size, and its parts."""
    low, differ, parts = [], [], []
    size = 1
    while size < 1 << 40:
        high = size * 100 // percent
        low.append(size)
        d = 2 * high * (100 - percent) // (100 + percent)
        k = d + 1 + np.arange(d + 5 if d < 1000 else d // 2, dtype=float) if d < 1 << 22 else np.array([1.6 * d])
        lacking = k * np.exp(-low[-2:][0] / k)
        enough = np.flatnonzero(k - lacking - 5 * np.sqrt(lacking) > d)
        differ.append(d)
        parts.append(0 if d == 0 else int(k[enough[0] if len(enough) else -1]))
        size = high + 1
    return np.array(low), np.array(differ), np.array(parts)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's set begins."""
    data, offsets = byte_view(column)
    words = Words(data, offsets, lower=True)
    h, at = words.windows(width)
    doc = words.doc[at]
    n_words = np.diff(words.first)
    for k in range(1, width):
        short = np.flatnonzero(n_words == k)
        whole = np.full(len(short), k, np.uint64)
        for i in range(k):
            whole = mix(whole * MIX_2 + words.key[words.first[short] + i])
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.argsort(h)
    by_doc = np.argsort(doc[order].astype(np.uint16 if len(n_words) < 65536 else np.int64), kind="stable")
    h, doc = h[order][by_doc], doc[order][by_doc]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n_words) + 1))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ BASE), dtype=np.uint64)])
    sizes = np.diff(first)
    return mix(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64) * MIX_2).view(np.int64)


def part_keys(h: np.ndarray, first: np.ndarray, low: np.ndarray, differ: np.ndarray, n_parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of each band and part of the sets."""
    sizes = np.diff(first)
    owners, keys = [], []
    for shift in (0, 1):
        band = np.searchsorted(low, np.maximum(sizes, 1), "right") - 1 + shift
        parts = np.where(sizes > 0, n_parts[band], 0)  # none where no element may differ: equal sets are one node anyway
        text = np.repeat(np.arange(len(sizes)), sizes)
        used = parts[text] > 0
        text, value = text[used], h[used]
        salt = mix(band.astype(np.uint64) * BASE + np.uint64(1))
        place = np.cumsum(parts) - parts
        slot = place[text] + ((mix(value ^ salt[text]) >> np.uint64(20)) % np.maximum(parts, 1).astype(np.uint64)[text]).astype(np.int64)
        content = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(content, slot, mix(value + MIX_2))
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = (np.arange(len(owner)) - place[owner]).astype(np.uint64)
        name = salt[owner] + number * MIX_2
        empty = np.bincount(slot, minlength=len(content)) == 0
        owners.append(owner[~empty])
        keys.append(mix(mix(content[~empty]) + name[~empty]))
        filled = sums(~empty, np.concatenate([place, [len(content)]]))
        for i in np.flatnonzero(empty & (filled <= differ[band])[owner]):  # if both sets lack this part, they agree in a part of a second cut
            d = owner[i]
            own = h[first[d] : first[d + 1]]
            second = np.zeros(parts[d], np.uint64)
            np.add.at(second, ((mix(own ^ name[i]) >> np.uint64(20)) % np.uint64(parts[d])).astype(np.int64), mix(own + MIX_2))
            owners.append(np.full(parts[d], d))
            keys.append(mix(mix(second + np.uint64(3)) + name[i] + np.arange(1, parts[d] + 1).astype(np.uint64) * BASE))
    return np.concatenate(owners), np.concatenate(keys)


def _row_hashes(k: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Names a row by its set and its k."""
    data, offsets = byte_view(k)
    return mix(hash_runs(data, offsets[:-1], np.diff(offsets)) ^ ids.view(np.uint64)).view(np.int64)


def signature(elements: np.ndarray) -> bytes:
    bits = max(BITS, 1 << (2 * len(elements) - 1).bit_length()) if len(elements) else BITS
    flags = np.zeros(bits, bool)
    flags[(mix(elements ^ MIX_2) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A signature as it would be with fewer bits, in 64-bit words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def text_key(text: str) -> tuple[Column, Column]:
    """Two hashes that name a text together."""
    return F.xxhash64(F.col(text).cast("string")).alias("h"), F.coalesce(F.crc32(F.col(text).cast("string").cast("binary")), F.lit(-1)).alias("check")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(k, doc_id, n, set_id, r, bits, h, check) per row; r names the row for looking its text up again, h and check its text."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                h, first = shingle_sets(part.column(2), width)
                n, ids = np.diff(first), set_ids(h, first)
                yield {"k": part.column(0), "doc_id": part.column(1), "n": n, "set_id": pa.array(ids, mask=n == 0), "r": _row_hashes(part.column(0), ids), "bits": [signature(h[a:b]) for a, b in zip(first, first[1:], strict=False)], "h": part.column(3), "check": part.column(4)}

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_pass(docs.select("_k", "doc_id", "_text", *text_key("_text")), f"k string, doc_id {kind}, n long, set_id long, r long, bits binary, h long, check long", work)


def _key_bits(docs: DataFrame) -> int:
    """Bits of a tile's name: so many that about one tile in ten thousand gets a stranger, at any size of the table."""
    n_bytes = docs.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    return min(62, 14 + max(16, int(n_bytes).bit_length()))


def packed_keys(key: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of a unit's keys: sorted keys, whose they are, and the sets in question with their sizes; equal sets count once."""
    _, first, same = np.unique(ids, return_index=True, return_inverse=True)
    mine = (first[same] == np.arange(len(ids)))[owner]
    key, owner = key[mine] >> np.uint64(64 - bits), owner[mine]
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    for part, where in _parted(key, bits, parts):
        sets, place = np.unique(owner[where], return_inverse=True)
        yield part, packed(dense(key[where]), place.astype(np.uint16 if len(sets) < 65536 else np.uint32), ids[sets], sizes[sets].astype(np.int64))


def tiles_of(blobs: list[bytes]) -> dict:
    """The (key, set_id, n) of the keys that several sets have, from the blobs of one part."""
    loaded = [unpacked(x) for x in blobs]
    key = np.concatenate([undense(x[0]) for x in loaded])
    ids, n = (np.concatenate([x[i][x[1]] for x in loaded]) for i in (2, 3))
    order = np.argsort(key)
    key, ids, n = key[order], ids[order], n[order]
    some = np.zeros(len(key), bool)
    some[1:] = key[1:] == key[:-1]
    some[:-1] |= some[1:].copy()
    key, ids, n = key[some], ids[some], n[some]
    order = np.lexsort((ids, key))
    key, ids, n = key[order], ids[order], n[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, n = key[new], ids[new], n[new]
    same = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] |= same
    many[:-1] |= same
    return {"key": key[many].view(np.int64), "set_id": ids[many], "n": n[many]}


def _shared(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, set_id, n) of the tiles with at least two sets. Keys travel packed, by ranges of keys, and those of one set stay there."""
    low, differ, n_parts = bands(percent)
    bits = _key_bits(docs)
    parts = max(partitions(docs.sparkSession), -(-(1 << max(0, bits - 14)) // PART_BYTES))

    def emit(batches):
        held, n_held, n_bytes = [], 0, 0

        def out():
            owner, key, ids, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            found = list(packed_keys(key, owner, ids, sizes, bits, parts))
            return {"part": [x[0] for x in found], "blob": [x[1] for x in found]}

        for batch in batches:
            for part in slices(batch, "_text"):
                h, first = shingle_sets(part.column(0), width)
                owner, key = part_keys(h, first, low, differ, n_parts)
                held.append((owner + n_held, key, set_ids(h, first), np.diff(first)))
                n_held, n_bytes = n_held + part.num_rows, n_bytes + part.nbytes
                if n_bytes >= UNIT_BYTES:
                    yield out()
                    held, n_held, n_bytes = [], 0, 0
        if held:
            yield out()

    def pick(batches):
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and blobs:
                    yield tiles_of(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield tiles_of(blobs)

    sent = arrow_pass(docs.select("_text"), "part int, blob binary", emit)
    return arrow_pass(sent.repartition(parts, "part").sortWithinPartitions("part"), "key long, set_id long, n long", pick)


def _filter_words(rows: DataFrame) -> np.ndarray:
    """A Bloom filter over r, in 64-bit words; its size doesn't depend on the rows."""
    bit = F.explode(F.array(F.col("r").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("r", 32).bitwiseAND(FILTER_BITS - 1))).alias("bit")
    words = rows.select(bit).groupBy(F.shiftrightunsigned("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("x"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r.w] = r.x
    return out.view(np.uint64)


def _filtered(rows: DataFrame):
    """A test of 64-bit names against the filter over ``r``: false for none of the rows."""
    known = rows.sparkSession.sparkContext.broadcast(_filter_words(rows))

    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in batches:
            yield pa.array(_holds(known.value, names.to_numpy().view(np.uint64)))

    return F.arrow_udf(test, "boolean")


def _holds(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    low = np.uint64(FILTER_BITS - 1)
    bits = [(words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) for bit in (r & low, r >> np.uint64(32) & low)]
    return (bits[0] & bits[1]).astype(bool)


def _arrays(docs: DataFrame, reps: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(set_id, elements) of the named sets, each from its representative's text. The filter picks those texts where
    they are read, so that no other text is moved; what it lets through besides finds no partner."""
    wanted = sets.distinct().join(reps, "set_id")
    known = docs.sparkSession.sparkContext.broadcast(_filter_words(wanted))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                h, first = shingle_sets(part.column(1), width)
                ids = set_ids(h, first)
                r = _row_hashes(part.column(0), ids).view(np.uint64)
                keep = np.flatnonzero(_holds(known.value, r) & (np.diff(first) > 0))
                yield {"set_id": ids[keep], "elements": [h[first[i] : first[i + 1]].view(np.int64) for i in keep]}

    return materialize(arrow_pass(docs.select("_k", "_text"), "set_id long, elements array<long>", work).dropDuplicates(["set_id"]), "arrays")


def may_link(n_a, n_b, differing, percent: int):
    """Whether sizes and differing bits allow a link: each differing bit is an element of one set alone."""
    total = n_a + n_b
    return (np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b)) & (100 * (total - differing) >= percent * (total + differing))


def _bit_matrix(column: pa.Array) -> np.ndarray:
    """Signatures under each other, folded to the shortest."""
    rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    words = min(map(len, rows))
    return np.stack([folded(x, words) for x in rows])


def _with(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("set_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])


def bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures let link."""

    def work(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            differing = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                words = min(len(x), len(y))
                differing[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
            keep = may_link(n_a, n_b, differing, percent)
            yield {"a": a[keep], "b": b[keep]}

    return arrow_pass(_with(pairs, reps, "n", "bits"), "a long, b long", work)


def verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""
    both = F.size(F.array_intersect("elements_a", "elements_b"))
    return _with(pairs, arrays, "elements").where(100 * both >= percent * (F.size("elements_a") + F.size("elements_b") - both)).select("a", "b")


def _met_before(first: np.ndarray, other: np.ndarray, key: int) -> np.ndarray:
    """Whether two sets share a tile before this one, as far as their first tiles tell."""
    return ((first[:, :, None] == other[:, None, :]) & (first[:, :, None] < key)).any((1, 2))


def _per_block_pair(tiles: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on the rows of each (key, p, q), which stream past one after the other; it yields dicts of columns."""

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            names = np.stack([table.column(c).to_numpy() for c in ("key", "p", "q")])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1
            borders = [0, *cuts.tolist(), table.num_rows]
            for a, b in zip(borders, borders[1:], strict=False):
                piece = table.slice(a, b - a)
                if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in ("key", "p", "q")):
                    yield from work(pa.concat_tables(held))
                    held = []
                held.append(piece)
        if held:
            yield from work(pa.concat_tables(held))

    return arrow_pass(tiles.repartition(partitions(tiles.sparkSession), "key", "p", "q").sortWithinPartitions("key", "p", "q"), schema, run)


def _may_link_in_tile(rows: pa.Table, percent: int, known: bool) -> np.ndarray:
    """Positions (i, j) of the pairs of different components that sizes and signatures let link, block p against block q;
    with ``known`` first tiles without those that share an earlier tile."""
    block, ids, n, root = (rows.column(c).to_numpy() for c in ("block", "set_id", "n", "root"))
    bits = _bit_matrix(rows.column("bits").combine_chunks())
    key, p, q = (rows.column(c)[0].as_py() for c in ("key", "p", "q"))
    first = np.array([x + [key] * (FIRST_TILES - len(x)) for x in rows.column("first").to_pylist()]) if known else None
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    out = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        keep = may_link(n[x][:, None], n[right][None, :], 0, percent) & (root[x][:, None] != root[right][None, :])
        if p == q:
            keep &= ids[x][:, None] < ids[right][None, :]
        i, j = np.nonzero(keep)
        for part in range(0, len(i), 1 << 16):
            a, b = x[i[part : part + (1 << 16)]], right[j[part : part + (1 << 16)]]
            ok = may_link(n[a], n[b], np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64), percent)
            a, b = a[ok], b[ok]
            if known:
                new = ~_met_before(first[a], first[b], key)
                a, b = a[new], b[new]
            out.append(np.stack([a, b], axis=1))
    return np.concatenate(out)


def _open_sets(tiles: DataFrame, percent: int) -> DataFrame:
    """(key, p, q, block, set_id, n, root) of the sets that may link with another component's in this block pair."""

    def work(rows: pa.Table):
        used = np.unique(_may_link_in_tile(rows, percent, known=True))
        if len(used):
            yield rows.select(["key", "p", "q", "block", "set_id", "n", "root"]).take(pa.array(used)).combine_chunks().to_batches()[0]

    return _per_block_pair(tiles, "key long, p int, q int, block int, set_id long, n long, root long", work)


def spanning(pairs, root: list, links) -> list[tuple[int, int]]:
    """Those of the pairs (i, j) that link and join two components, taken one by one; ``root`` names the components before."""
    above: dict = {}

    def top(x):
        while x in above:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    out = []
    for i, j in pairs:
        x, y = top(root[i]), top(root[j])
        if x != y and links(i, j):
            above[x] = y
            out.append((i, j))
    return out


def _tile_links(sets: DataFrame, percent: int) -> DataFrame:
    """A forest of the links (a, b) within each block pair. sets: as ``_open_sets`` gives them, and their elements."""

    def work(rows: pa.Table):
        elements = [x.values.to_numpy().view(np.uint64) for x in rows.column("elements").combine_chunks()]
        bits = pa.array([signature(x) for x in elements], pa.binary())
        pairs = _may_link_in_tile(rows.append_column("bits", bits), percent, known=False)
        ids = rows.column("set_id").to_pylist()

        def links(i, j):
            x, y = (elements[i], elements[j]) if len(elements[i]) < len(elements[j]) else (elements[j], elements[i])
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            return 100 * both >= percent * (len(x) + len(y) - both)

        found = spanning(pairs.tolist(), rows.column("root").to_pylist(), links)
        if found:
            yield {"a": [min(ids[i], ids[j]) for i, j in found], "b": [max(ids[i], ids[j]) for i, j in found]}

    return _per_block_pair(sets, "a long, b long", work)


def _open_tiles(shared: DataFrame, roots: DataFrame, reps: DataFrame) -> DataFrame:
    """The tiles that hold several components, one of those with the same sets, cut into pairs of blocks."""
    named = shared.join(roots, shared.set_id == roots.node, "left").select("key", "set_id", "n", F.coalesce("root", "set_id").alias("root"))
    by_tile = named.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("same"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    one = by_tile.groupBy("c", "same").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    member = materialize(named.join(one, "key").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("blocks")).cast("int")), "members")
    first = member.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_TILES).alias("first"))
    rows = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "set_id", "n", "root").join(first.join(reps.select("set_id", "bits"), "set_id"), "set_id")


def _rooted(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: doc_id, n_shingles, set_id, root (of its component; null without words), h and check of its text."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("_text")).withColumn("_k", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.xxhash64("_text"))))
    sets = materialize(_sets(docs, width), "sets")
    shared = materialize(_shared(docs, width, percent), "tiles")
    in_tiles = shared.select("set_id").distinct()
    reps = materialize(sets.join(in_tiles, "set_id", "left_semi").groupBy("set_id").agg(F.min_by(F.struct("n", "r", "bits"), "k").alias("x")).select("set_id", "x.*"), "signatures")
    in_tile = Window.partitionBy("key")
    chained = [
        shared.select(F.col("set_id").alias("x"), F.lag("set_id").over(in_tile.orderBy(*order)).alias("y")) for order in ((F.col("n"), F.col("set_id")), (F.xxhash64("set_id"), F.col("n")))
    ]
    first_pairs = chained[0].union(chained[1]).where("y IS NOT NULL").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    may = materialize(bounded(first_pairs, reps, percent), "pairs")
    arrays = _arrays(docs, reps, may.select(F.col("a").alias("set_id")).union(may.select("b")), width)
    links = materialize(verified(may, arrays, percent), "links")
    release(may, arrays)
    rest = materialize(_open_sets(_open_tiles(shared, materialize(components(links, "roots"), "roots"), reps), percent), "open")
    release(shared)
    arrays = _arrays(docs, reps, rest.select("set_id"), width)
    more = materialize(_tile_links(rest.join(arrays, "set_id"), percent), "links")
    release(rest, arrays)
    roots = components(links.union(more), "roots")
    return sets.join(roots, sets.set_id == roots.node, "left").select("doc_id", F.col("n").alias("n_shingles"), "set_id", F.coalesce("root", "set_id").alias("root"), "h", "check")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id of its component), set_id. Extra columns are left out."""
    rows = _rooted(docs, width, percent)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "set_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, with one row of each component: that of the least doc_id (rows without doc_id come last), of
    several of that doc_id the one of the least hashes. Each row is decided by its doc_id and text together. Rows without
    words stay; of those repeated with a doc_id one stays."""
    name = ["doc_id", "h", "check"]
    found = materialize(_rooted(docs, width, percent).groupBy("root", *name).agg(F.count("*").alias("c")), "rooted")
    order = F.struct(F.col("doc_id").isNull().alias("last"), *name)
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("least"))
    gone = materialize(found.join(least, "root").where(order != F.col("least")).select(*name), "gone")
    again = materialize(found.where("c > 1 AND (root IS NOT NULL OR doc_id IS NOT NULL)").join(_named(gone), _same(), "left_anti").select(*name), "again")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", *text_key("text"))
    changed = gone.union(again)
    if changed.isEmpty():
        return docs
    name_of = F.xxhash64(*name)
    maybe = _filtered(changed.select(name_of.alias("r")))(name_of)
    sure, left = left.where(~maybe), left.where(maybe)  # texts that no decision names stay where they are
    left = left.join(_named(gone), _same(), "left_anti")
    if not again.isEmpty():
        twice = left.join(_named(again), _same(), "left_semi")
        row = F.xxhash64(*[F.col(f"whole.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
        twice = twice.groupBy(*name).agg(F.min_by("whole", row).alias("whole")).select("whole", *name)
        left = left.join(_named(again), _same(), "left_anti").unionByName(twice)
    left = sure.select("whole").unionByName(left.select("whole"))
    return left.select("whole.*")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("check").alias("_check"))


def _same() -> Column:
    """Equal rows of (doc_id, h, check) and of ``_named``, null ids included."""
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("check") == F.col("_check"))
