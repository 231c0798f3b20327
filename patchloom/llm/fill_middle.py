"""Fill-in-middle transformation: a pyarrow.compute pipeline over batches of texts.

Each batch of texts is split into a list array of units (code points or lines), flattened with its parent
indices, and every unit gets its ordinal within its text. Two cuts per text give each unit a role (prefix, middle
or suffix); the units of one role are filtered, rebuilt as lists by their parents and joined (``binary_join``).
Markers and pieces are joined element by element into the output.

Cuts and forms come from a hash of seed and doc_id, so that reruns and other partitionings agree. A text that is
empty, or holds a marker itself, stays plain; so its output can always be taken apart again. Units are handled in
segments of a megabyte: a very long text needs memory for its pieces, not for a table of all its units.

A null text counts as empty, a null doc_id as an empty number. Equal rows get equal results, an empty table an empty
one. Other columns stay as they are; if they clash with a result column, the result takes the name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.llm.tables import arrow_pass
from patchloom.llm.textbytes import byte_view, slices

#: Markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEGMENT = 1 << 20


def units(column: pa.Array, kind: str = "code_points") -> tuple[pa.Array, np.ndarray]:
    """The texts as lists of units, and how many code points each unit has. Lists and units are views of the texts' bytes."""
    data, offsets = byte_view(column)
    starts = (data & 0xC0) != 0x80
    if kind == "lines":
        points = np.concatenate([[0], np.cumsum(starts)])
        starts = np.zeros(len(data), bool)
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts[1:] |= data[:-1] == 0x0A
    at = np.append(np.flatnonzero(starts), len(data))
    sizes = np.diff(points[at]) if kind == "lines" else np.ones(len(at) - 1, np.int64)
    single = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(at, offsets), pa.int64()), single), sizes


def by_role(lists: pa.Array, base: np.ndarray, first_cut: np.ndarray, second_cut: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each list: of its units, numbered from ``base``, those before the first cut, up to the second, and the rest."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    ordinal = np.arange(len(flat)) - lists.offsets.to_numpy()[:-1][parent] + base[parent]
    role = (ordinal >= first_cut[parent]).astype(np.int8) + (ordinal >= second_cut[parent])
    out = []
    for wanted in range(3):
        mask = role == wanted
        counts = np.bincount(parent[mask], minlength=len(lists))
        rebuilt = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), flat.filter(pa.array(mask)))
        out.append(pc.binary_join(rebuilt, pa.scalar("", pa.large_string())))
    return out


def segments(text: pa.Array) -> pa.Array:
    """One long text in pieces of ``SEGMENT`` bytes or a little less, cut before a code point."""
    data, _ = byte_view(text)
    cuts, at = [0], SEGMENT
    while at < len(data):
        while (data[at] & 0xC0) == 0x80:
            at -= 1
        cuts.append(at)
        at += SEGMENT
    return pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.array([*cuts, len(data)], np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def pieces(text: pa.Array, first_cut: np.ndarray, second_cut: np.ndarray, kind: str) -> tuple[list[pa.Array], list[np.ndarray]]:
    """Prefix, middle and suffix of each text and their code points."""
    if len(text) > 1 or pc.binary_length(text)[0].as_py() <= SEGMENT or kind != "code_points":
        lists, _ = units(text, kind)
        out = by_role(lists, np.zeros(len(text), np.int64), first_cut, second_cut)
    else:
        parts, done, held = segments(text), 0, ([], [], [])
        for part in (parts.slice(i, 1) for i in range(len(parts))):
            lists, sizes = units(part, kind)
            for found, piece in zip(held, by_role(lists, np.array([done]), first_cut, second_cut), strict=True):
                found.append(piece[0].as_py())
            done += len(sizes)
        out = [pc.binary_join(pa.array([x], pa.list_(pa.large_string())), pa.scalar("", pa.large_string())) for x in held]
    return out, [pc.utf8_length(x).to_numpy() for x in out]


def _counted(text: pa.Array, kind: str) -> np.ndarray:
    if kind == "code_points":
        return pc.utf8_length(text).to_numpy()
    return pc.list_value_length(units(text, kind)[0]).to_numpy()


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transformed(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, kind: str = "code_points", text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The rows with n (units), form (``psm``, ``spm`` or ``plain``), prefix_chars, middle_chars (code points; null if plain) and output.

    The cuts are the smaller and larger of two draws from 0 to n. ``plain_percent`` of the texts stay plain, of the rest
    ``spm_percent`` get the order suffix, prefix, middle. ``keep`` names the columns that stay (default: all)."""
    if kind not in ("code_points", "lines"):
        raise ValueError("units are code_points or lines")
    result = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in result]
    wide = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = docs.select(wide, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), *draws(F.col(f"`{key}`"), seed))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.large_string())
                h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
                n = _counted(texts, kind)
                a, b = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                marked = np.any([pc.match_substring(texts, m).to_numpy(zero_copy_only=False) for m in (PREFIX, SUFFIX, MIDDLE)], axis=0)
                plain = marked | (n == 0) | (h3 % 100 >= 100 - plain_percent)
                spm = h4 % 100 < spm_percent
                (p, m, s), (n_p, n_m, _) = pieces(texts, a, b, kind)
                join = lambda *x: pc.binary_join_element_wise(*[pa.scalar(y, pa.large_string()) if isinstance(y, str) else y for y in x], pa.scalar("", pa.large_string()))
                psm = join(PREFIX, p, SUFFIX, s, MIDDLE, m)
                output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), join(SUFFIX, s, PREFIX, p, MIDDLE, m), psm))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield {"row": part.column("row").cast(row_type), "n": n, "form": pa.array(form), "prefix_chars": pa.array(n_p.astype(np.int64), mask=plain), "middle_chars": pa.array(n_m.astype(np.int64), mask=plain), "output": output.cast(pa.string())}

    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields])
    row_type = to_arrow_schema(schema).field("row").type
    done = arrow_pass(rows, schema, work)
    return done.select("row.*", *result)


def restored(output: Column, form: Column) -> Column:
    """The exact text from output and form. A marker is found at its first place: the pieces hold none, and none overlaps itself."""

    def between(first: str, second: str) -> Column:
        begin = F.locate(first, output) + len(first)
        return F.substr(output, begin, F.locate(second, output) - begin)

    middle = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
