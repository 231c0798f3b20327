"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A byte-pair encoder works within pre-tokens, so a document's tokens are the sum over its pre-tokens. They lie in blocks
under a tree of sums (characters, tokens). An edit finds its place by descending the tree, cuts anew only from shortly
before the edit until the cuts meet the old ones behind it, and brings the sums above the touched blocks up to date.

An edit is (at, drop, put): at a character offset, cut ``drop`` characters and insert ``put``; offsets beyond the text
mean its end. The edits of a document are one sequence, in order, each on the outcome of those before. Null texts are
empty; a null edit or null parts of it change nothing. Repeated rows are counted alike, an empty table gives an empty
result, other columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import arrow_pass

#: Where the ranks of the encoder lie; any byte-level file of the same form will do.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How that encoder cuts pre-tokens (fixed value, published with it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token depends on at most this many characters behind it (the pattern's longest look ahead).
LOOK_AHEAD = 2
BLOCK = 64
KNOWN_PIECES = 200_000


class Counter:
    """Tokens of a pre-token, remembered for the most recent pieces."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            n = self.known[piece] = len(self.encoder.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)


class Tree:
    """Sums over blocks of (characters, tokens) of pre-tokens; node i has the children 2i and 2i + 1."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.blocks = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.grow()

    def grow(self) -> None:
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self.add(i)

    def add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def block_at(self, place: int) -> tuple[int, int]:
        """The block that holds a character (the last one at the end), and its first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.chars[node] and self.holds(node + 1):
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def first_of(self, node: int) -> int:
        while node < self.size:
            node *= 2
        return node - self.size

    def holds(self, node: int) -> bool:
        return self.first_of(node) < len(self.blocks)

    def replace(self, first: int, last: int, lengths: list[int], tokens: list[int]) -> None:
        """Put pre-tokens in place of the blocks first … last."""
        if first == last and len(lengths) <= 2 * BLOCK:
            self.blocks[first] = (lengths, tokens)
            node = self.size + first
            self.chars[node], self.tokens[node] = sum(lengths), sum(tokens)
            while node > 1:
                node //= 2
                self.add(node)
            return
        self.blocks[first : last + 1] = [(lengths[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or ([] if len(self.blocks) > last - first + 1 else [([], [])])
        self.grow()

    def leaves(self) -> tuple[list[int], list[int]]:
        return [n for a, _ in self.blocks for n in a], [n for _, b in self.blocks for n in b]

    @property
    def total(self) -> int:
        return self.tokens[1]


class Edited:
    """A text with its tree."""

    def __init__(self, text: str, tree: Tree, counter: Counter):
        self.text, self.tree, self.counter, self.encoded = text, tree, counter, 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Edited:
        pieces = counter.pieces(text)
        return cls(text, Tree([len(p) for p in pieces], [counter.count(p) for p in pieces]), counter)

    def edit(self, at: int, drop: int, put: str) -> None:
        old, tree = self.text, self.tree
        at = max(0, min(at, len(old)))
        end = max(at, min(at + drop, len(old)))
        self.text = new = old[:at] + put + old[end:]
        shift = len(new) - len(old)
        first, begin = tree.block_at(max(0, at - LOOK_AHEAD - 1))
        while first > 0 and begin > at - LOOK_AHEAD - 1:  # the block before ends too near
            first -= 1
            begin -= tree.chars[tree.size + first]
        lengths, tokens, place = [], [], begin
        for n, t in zip(*tree.blocks[first], strict=True):  # pre-tokens that end before all that looks at the edit
            if place + n > at - LOOK_AHEAD:
                break
            lengths.append(n)
            tokens.append(t)
            place += n
        last, reached = first, begin  # the next old pre-token: block, number, offset
        number = len(lengths)
        reached = place
        while True:
            m = self.counter.cut.match(new, place) if place < len(new) else None
            while reached + shift < place or reached < end:  # old pre-tokens that are gone or already covered
                if number >= len(tree.blocks[last][0]):
                    if last + 1 >= len(tree.blocks):
                        break
                    last, number = last + 1, 0
                    continue
                reached += tree.blocks[last][0][number]
                number += 1
            if place >= len(put) + at and reached + shift == place or m is None:
                break
            piece = m.group()
            lengths.append(len(piece))
            tokens.append(self.counter.count(piece))
            self.encoded += 1
            place = m.end()
        if place < len(new):
            lengths += tree.blocks[last][0][number:]
            tokens += tree.blocks[last][1][number:]
        else:
            last = len(tree.blocks) - 1
        tree.replace(first, last, lengths, tokens)


_COUNTER: dict[int, Counter] = {}


def _counter(ranks) -> Counter:
    if id(ranks) not in _COUNTER:
        _COUNTER[id(ranks)] = Counter(ranks.value)
    return _COUNTER[id(ranks)]


def _ranks(spark, path: str):
    """The encoder's ranks (a file of fixed size), read once and sent to all."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def trees(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Per document: doc_id, text, its pre-tokens (``lengths`` and ``tokens``, the leaves of its tree) and n_tokens."""
    known = _ranks(docs.sparkSession, ranks)
    extra = [c for c in ("edits",) if c in docs.columns]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *extra)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text string, {''.join(f'{c} {dict(rows.dtypes)[c]}, ' for c in extra)}lengths binary, tokens binary, n_tokens long"

    def work(batches: Iterator[pa.RecordBatch]):
        counter = _counter(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lengths, tokens, totals = [], [], []
                for text in part.column(1).to_pylist():
                    pieces = counter.pieces(text or "")
                    counts = [counter.count(p) for p in pieces]
                    lengths.append(np.array([len(p) for p in pieces], np.int32).tobytes())
                    tokens.append(np.array(counts, np.int32).tobytes())
                    totals.append(sum(counts))
                yield {"doc_id": part.column(0), "text": part.column(1)} | {c: part.column(2 + i) for i, c in enumerate(extra)} | {"lengths": lengths, "tokens": tokens, "n_tokens": totals}

    return arrow_pass(rows, schema, work)


def edited(state: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The rows of ``trees`` with a column ``edits`` (array of at, drop, put) after their edits: doc_id, text, lengths, tokens,
    n_before, n_tokens, n_pieces, n_edits and n_encoded, the pre-tokens that were encoded anew."""
    known = _ranks(state.sparkSession, ranks)
    rows = state.select("doc_id", "text", "edits", "lengths", "tokens", "n_tokens")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text string, lengths binary, tokens binary, n_before long, n_tokens long, n_pieces long, n_edits long, n_encoded long"

    def work(batches):
        counter = _counter(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {c: [] for c in ("text", "lengths", "tokens", "n_tokens", "n_pieces", "n_edits", "n_encoded")}
                for text, edits, lengths, tokens in zip(*(part.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    now = Edited(text or "", Tree(np.frombuffer(lengths, np.int32).tolist(), np.frombuffer(tokens, np.int32).tolist()), counter)
                    todo = [e for e in edits or [] if e and None not in e.values()]
                    for e in todo:
                        now.edit(e["at"], e["drop"], e["put"])
                    a, b = now.tree.leaves()
                    for c, x in zip(out, (now.text, np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes(), now.tree.total, len(a), len(todo), now.encoded), strict=True):
                        out[c].append(x)
                yield {"doc_id": part.column(0), "n_before": part.column(5)} | out

    return arrow_pass(rows, schema, work)


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits of each text at hashed places: a cut, an insertion of its own first words, a replacement."""
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.coalesce(F.char_length("text"), F.lit(0)) + 1).cast("int")
    change = lambda k, drop, put: F.struct(place(k).alias("at"), F.lit(drop).alias("drop"), put.alias("put"))
    first = F.coalesce(F.substring("text", 1, 24), F.lit(""))
    return docs.select("doc_id", "text", F.array(change(1, 20, F.lit("")), change(2, 0, first), change(3, 12, F.lit(" [removed] "))).alias("edits"))
