"""LM scoring: a gated recurrent language model over words, in numpy inside Spark tasks.

A word's probability is that of its class given the text so far, times its share of the class. Words seen at least
twice in training form classes by their ending; words seen once stand for unseen ones and form the class of rare
words, whose shares follow from how many words were seen once and twice; the end has a class of its own. The output
softmax runs over classes only, so its cost doesn't grow with the vocabulary.

1. Texts are dealt into chunks. Every chunk sends its distinct words with their training counts; sums over the whole
   corpus come back to each chunk, in the order sent, and turn its texts into class codes.
2. The network is fitted from the training texts of lowest hash (``WARM_DOCS``, a bounded start), then every task goes
   once through all its training texts by truncated backpropagation, and the parameters are averaged by tokens.
3. Every text is scored whole; its state goes on from window to window and starts at zero with each text.

Held out are documents whose crc32 of doc_id as text leaves 1 modulo 5; without doc_id a text is in training. Null and
empty texts hold the end only. Repeated rows count and are scored as often as they occur. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.suffixes import packed, unpacked
from patchloom.llm.tables import arrow_pass, materialize, partitions
from patchloom.llm.textbytes import BASE, MIX_2, Words, byte_view, mix

CLASSES, HIDDEN, LANES, WINDOW = 64, 24, 256, 32
END, RARE, FIRST_ENDING = 0, 1, 2
END_KEY = np.uint64(0x454E44)
#: Texts of the first fit and how often it sees them; tokens that a task holds at once; learning rates of both fits.
WARM_DOCS, WARM_PASSES, HELD_TOKENS, RATES = 2000, 3, 4_000_000, (0.01, 0.003)


class Network:
    """Gated recurrent units over class codes; parameters lie in one vector."""

    shapes = (("inputs", (CLASSES + 1, 3 * HIDDEN)), ("state", (HIDDEN, 3 * HIDDEN)), ("out", (HIDDEN, CLASSES)), ("bias", (1, CLASSES)))

    def __init__(self, vector: np.ndarray | None = None, seed: int = 3):
        total = sum(a * b for _, (a, b) in self.shapes)
        self.vector = np.random.default_rng(seed).normal(0, 0.15, total).astype(np.float32) if vector is None else np.array(vector, np.float32)
        self.parts = self.views(self.vector)

    @classmethod
    def views(cls, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, (a, b) in cls.shapes:
            out[name] = vector[at : at + a * b].reshape(a, b)
            at += a * b
        return out

    def forward(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step of a window (steps, lanes, hidden) from the codes before; ``fresh`` lanes start at zero."""
        p, states, kept = self.parts, np.empty((*before.shape, HIDDEN), np.float32), []
        given = p["inputs"][before]
        for t in range(len(before)):
            h = h * ~fresh[t][:, None] if fresh[t].any() else h
            u = h @ p["state"]
            gates = 1 / (1 + np.exp(-(given[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(given[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            kept.append((h, u, z, r, new))
            h = new + z * (h - new)
            states[t] = h
        return states, kept

    def log_shares(self, states: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the classes."""
        x = states.reshape(-1, HIDDEN) @ self.parts["out"] + self.parts["bias"]
        x -= x.max(1, keepdims=True)
        x -= np.log(np.exp(x).sum(1, keepdims=True))
        return x

    def gradient(self, before, fresh, codes, live, h) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of a window's mean loss, truncated at its start, and the state at its end."""
        p, grad = self.parts, np.zeros_like(self.vector)
        g = self.views(grad)
        states, kept = self.forward(before, fresh, h)
        flat = states.reshape(-1, HIDDEN)
        error = np.exp(self.log_shares(states))
        error[np.arange(len(error)), codes.ravel()] -= 1
        error *= live.reshape(-1, 1) / np.float32(max(live.sum(), 1))
        g["out"][:] = flat.T @ error
        g["bias"][:] = error.sum(0)
        from_out = (error @ p["out"].T).reshape(states.shape)
        back = np.zeros_like(h)
        to_inputs = np.empty((*before.shape, 3 * HIDDEN), np.float32)
        for t in range(len(before) - 1, -1, -1):
            h0, u, z, r, new = kept[t]
            back = back + from_out[t]
            d_new = back * (1 - z) * (1 - new * new)
            d = to_inputs[t]
            d[:, :HIDDEN] = back * (h0 - new) * z * (1 - z)
            d[:, HIDDEN : 2 * HIDDEN] = d_new * u[:, 2 * HIDDEN :] * r * (1 - r)
            d[:, 2 * HIDDEN :] = d_new
            to_state = d.copy()
            to_state[:, 2 * HIDDEN :] *= r
            g["state"] += h0.T @ to_state
            back = (back * z + to_state @ p["state"].T) * ~fresh[t][:, None]
        one_hot = np.zeros((before.size, CLASSES + 1), np.float32)
        one_hot[np.arange(before.size), before.ravel()] = 1
        g["inputs"][:] = one_hot.T @ to_inputs.reshape(-1, 3 * HIDDEN)
        return grad, states[-1]


class Adam:
    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.step = network, rate, 0
        self.mean, self.square = np.zeros_like(network.vector), np.zeros_like(network.vector)

    def apply(self, grad: np.ndarray) -> None:
        grad *= min(1.0, 1.0 / (float(np.sqrt((grad * grad).sum())) + 1e-9))
        self.step += 1
        self.mean += 0.1 * (grad - self.mean)
        self.square += 0.01 * (grad * grad - self.square)
        self.network.vector -= self.rate * (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.99**self.step)) + 1e-8)


def lanes_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Texts (class codes) behind each other in lanes of similar length, the longest first: codes, first steps, live steps, and each text's lane, begin and end."""
    n = min(LANES, max(1, len(texts)))
    length, spots, lanes = np.zeros(n, np.int64), [(0, 0, 0)] * len(texts), [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        lane = int(length.argmin())
        spots[i] = (lane, int(length[lane]), int(length[lane]) + len(texts[i]))
        lanes[lane].append(i)
        length[lane] += len(texts[i])
    rank = np.argsort(np.argsort(-length, kind="stable"), kind="stable")
    spots = [(int(rank[lane]), begin, end) for lane, begin, end in spots]
    steps = int(-(-length.max() // WINDOW) * WINDOW)
    codes, fresh, live = np.zeros((steps, n), np.uint8), np.zeros((steps, n), bool), np.zeros((steps, n), bool)
    for lane, begin, end in spots:
        fresh[begin, lane] = True
        live[begin:end, lane] = True
    for text, (lane, begin, end) in zip(texts, spots, strict=True):
        codes[begin:end, lane] = text
    return codes, fresh, live, spots


def _windows(codes, fresh, live):
    """(rows, lanes, codes before) of each window: lanes that have ended are left out."""
    before = np.concatenate([np.full((1, codes.shape[1]), CLASSES, codes.dtype), codes[:-1]]) if len(codes) else codes
    before = np.where(fresh, CLASSES, before)
    for at in range(0, len(codes), WINDOW):
        lanes = int(live[at].sum())
        yield (slice(at, at + WINDOW), slice(0, lanes)), before[at : at + WINDOW, :lanes]


def train(network: Network, texts: list[np.ndarray], adam: Adam) -> None:
    codes, fresh, live, _ = lanes_of(texts)
    h = np.zeros((codes.shape[1], HIDDEN), np.float32)
    for at, before in _windows(codes, fresh, live):
        grad, h = network.gradient(before, fresh[at], codes[at], live[at], h[at[1]])
        adam.apply(grad)


def log_likelihood(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's class codes."""
    codes, fresh, live, spots = lanes_of(texts)
    h, got = np.zeros((codes.shape[1], HIDDEN), np.float32), np.zeros(codes.shape, np.float32)
    for at, before in _windows(codes, fresh, live):
        states, _ = network.forward(before, fresh[at], h[at[1]])
        h = states[-1]
        logs = network.log_shares(states)
        got[at] = logs[np.arange(len(logs)), codes[at].ravel()].reshape(before.shape)
    return np.array([got[a:b, lane].sum(dtype=float) for lane, a, b in spots]) / np.log(10)


def groups_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Rows with about ``HELD_TOKENS`` codes together."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            held.append(part)
            n += sum(len(x.as_buffer()) for x in part.column(column))
            if n >= HELD_TOKENS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _codes(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column]


def _chunk_words(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, its sorted distinct keys, each word's number among them, the class of each key, training counts."""
    data, offsets = byte_view(table.column("text"))
    words = Words(data, offsets, lower=True)
    keys, at, place = np.unique(words.key, return_index=True, return_inverse=True)
    last = words.end[at] - 1
    before = np.where(last > words.start[at], words.data[last - 1], 0).astype(np.uint64)
    ending = mix(words.data[last].astype(np.uint64) * BASE + before * MIX_2) if len(last) else np.zeros(0, np.uint64)
    kind = FIRST_ENDING + (ending % np.uint64(CLASSES - FIRST_ENDING)).astype(np.uint8)
    training = ~table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
    counts = np.bincount(place, training[words.doc], len(keys)).astype(np.int64)
    return words, keys, place, kind, counts


def encoded(docs: DataFrame) -> DataFrame:
    """Per text: doc_id, held_out, n_tokens, n_known, known_log (sum of log10(c + 0.5)), twice_log (sum of log10 c over words seen
    at least twice), once, unseen, codes; and rows with ``stats``: sums over words of each class, then of words seen once, twice,
    at all, and tokens."""
    n = partitions(docs.sparkSession)
    parts = n
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.crc32(name.cast("binary")) % 5 == 1).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * n)).cast("int").alias("pid"))
    texts = texts.repartition(n, "pid")

    def by_part(keys):
        part = ((keys >> np.uint64(7)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def send(key, table):
        _, keys, _, kind, counts = _chunk_words(table)
        ends = int((~table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)).sum())
        keys, kind, counts = np.append(keys, END_KEY), np.append(kind, END), np.append(counts, ends)
        order, borders = by_part(keys)
        used = np.flatnonzero(np.diff(borders))
        blobs = [packed(keys[at], kind[at].astype(np.uint8), counts[at].astype(np.int32 if counts.max() < 1 << 31 else np.int64)) for at in (order[borders[i] : borders[i + 1]] for i in used)]
        return pa.table({"part": pa.array(used, pa.int32()), "pid": pa.array([key[0].as_py()] * len(used), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def total(batches):
        part, held = None, []

        def close():
            loaded = [unpacked(x) for _, x in held]
            keys, kind, counts = (np.concatenate([x[i] for x in loaded]) for i in range(3))
            names, at, place = np.unique(keys, return_index=True, return_inverse=True)
            c = np.bincount(place, counts, len(names)).astype(np.int64)
            many = c >= 2
            stats = np.concatenate([np.bincount(kind[at][many], c[many], CLASSES), [(c == 1).sum(), (c == 2).sum(), (c > 0).sum(), c.sum()]])
            ends = np.cumsum([len(x[0]) for x in loaded])
            back = [packed(c[place[e - len(x[0]) : e]]) for e, x in zip(ends, loaded, strict=True)]
            return {"part": [part] * (len(held) + 1), "pid": [*(p for p, _ in held), -1 - part], "blob": [*back, packed(stats)]}

        for batch in batches:
            for now, pid, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != part and held:
                    yield close()
                    held = []
                part = now
                held.append((pid, blob))
        if held:
            yield close()

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, twice_log double, once long, unseen long, codes binary, stats array<double>"
    fields = ("doc_id", "held_out", "n_tokens", "n_known", "known_log", "twice_log", "once", "unseen", "codes")
    kinds = dict(zip(fields, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary()), strict=True))

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            stats = pa.array([list(unpacked(x)[0]) for x in right.column("blob").to_pylist()], pa.list_(pa.float64()))
            return pa.table({f: pa.nulls(len(stats), t) for f, t in kinds.items()} | {"stats": stats})
        words, keys, place, kind, _ = _chunk_words(left)
        keys = np.append(keys, END_KEY)
        order, borders = by_part(keys)
        c = np.zeros(len(keys), np.int64)
        for part, blob in zip(right.column("part").to_pylist(), right.column("blob").to_pylist(), strict=True):
            c[order[borders[part] : borders[part + 1]]] = unpacked(blob)[0]
        end_count = c[-1]
        own = np.where(c[:-1] >= 2, kind, RARE).astype(np.uint8)
        word_c, code = c[:-1][place], own[place]
        rows = left.num_rows
        per_text = lambda x: np.bincount(words.doc, x, rows)
        with np.errstate(divide="ignore"):
            twice = np.where(c[:-1] >= 2, np.log10(np.maximum(c[:-1], 1)), 0.0)[place]
        out = {
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": np.diff(words.first) + 1, "n_known": per_text(word_c > 0).astype(np.int64) + int(end_count > 0),
            "known_log": per_text(np.log10(c[:-1] + 0.5)[place]) + np.log10(end_count + 0.5), "twice_log": per_text(twice),
            "once": per_text(word_c == 1).astype(np.int64), "unseen": per_text(word_c == 0).astype(np.int64), "codes": [code[a:b].tobytes() + bytes([END]) for a, b in zip(words.first, words.first[1:], strict=False)],
        }
        return pa.table({f: pa.array(out[f], t) if not isinstance(out[f], pa.ChunkedArray) else out[f].cast(t) for f, t in kinds.items()} | {"stats": pa.nulls(rows, pa.list_(pa.float64()))})

    sent = texts.groupBy("pid").applyInArrow(send, "part int, pid int, blob binary")
    back = arrow_pass(sent.repartition(n, "part").sortWithinPartitions("part"), "part int, pid int, blob binary", total)
    return texts.groupBy("pid").cogroup(back.groupBy("pid")).applyInArrow(encode, schema)


def fit(rows: DataFrame) -> np.ndarray:
    """The network's parameters from encoded training texts."""
    training = rows.where("codes IS NOT NULL AND NOT held_out")

    def task(rate: float, vector, passes: int):
        def work(batches):
            network, weight = Network(vector), 0
            adam = Adam(network, rate)
            for table in groups_of(batches, 0):
                texts = _codes(table.column(0))
                for _ in range(passes):
                    train(network, texts, adam)
                weight += sum(map(len, texts))
            if weight:
                yield {"weight": [float(weight)], "vector": [(network.vector.astype(float) * weight).tolist()]}

        return work

    schema = "weight double, vector array<double>"
    first = arrow_pass(training.orderBy(F.xxhash64("doc_id", F.length("codes"))).limit(WARM_DOCS).select("codes").coalesce(1), schema, task(RATES[0], None, WARM_PASSES)).first()
    if first is None:
        return Network().vector
    start = np.array(first.vector) / first.weight
    trained = materialize(arrow_pass(training.select("codes"), schema, task(RATES[1], start, 1)), "networks")
    weight = trained.agg(F.sum("weight")).first()[0]
    means = trained.select(F.posexplode("vector")).groupBy("pos").agg(F.sum("col").alias("total")).orderBy("pos").collect()
    return np.array([r.total for r in means]) / weight


def scored(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = materialize(encoded(docs), "codes")
    sums_ = {r.pos: r.total for r in rows.where("stats IS NOT NULL").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("total")).collect()}
    stats = np.array([sums_.get(i, 0.0) for i in range(CLASSES + 4)])
    shares, (once, twice, known, tokens) = stats[:CLASSES], stats[CLASSES:]
    unseen_share = (once + 1) / (once + 2 * twice + 2)
    vector = fit(rows)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def work(batches):
        network = Network(vector)
        of_class = np.log10(np.maximum(shares, 1.0))
        of_class[[END, RARE]] = 0
        for table in groups_of(batches, 8):
            texts = _codes(table.column("codes"))
            get = lambda c: table.column(c).to_numpy()  # noqa: B023, E731
            inside = get("twice_log") - np.array([of_class[x].sum() for x in texts]) + get("once") * np.log10((1 - unseen_share) / max(once, 1)) + get("unseen") * np.log10(unseen_share)
            yield {
                "doc_id": table.column("doc_id").combine_chunks(), "held_out": table.column("held_out").combine_chunks(), "n_tokens": get("n_tokens"), "n_known": get("n_known"), "train_tokens": np.full(len(texts), int(tokens)),
                "base_score": get("known_log") - get("n_tokens") * np.log10(tokens + 0.5 * (known + 1)), "score": log_likelihood(network, texts) + inside,
            }

    return arrow_pass(rows.where("codes IS NOT NULL").drop("stats"), schema, work)
