"""Manifest, fixed-block dedup and fill-in-middle against brute force, and on nulls, empty texts, ties, repeats, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import anchors, fill_middle, jaccard, manifest, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, tree string, lo long, pid string, `Form` string"
SPACES = " \t\n\v\f\r"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    for c in SPACES:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    text = lambda n: "".join(f"{rng.choice(['Wort', 'mot', 'née', 'x', 'OF'])}{rng.randrange(40)}{rng.choice([' ', chr(10), '  '])}" for _ in range(n))
    shared, longer = text(60), text(160)
    out = [(i, text(rng.choice([0, 1, 3, 49, 50, 51, 120]))) for i in range(90)]
    out += [(100 + i, text(i) + shared + text(30)) for i in range(30)]
    out += [(150 + i, text(3 * i) + longer[: 400 + 20 * i]) for i in range(12)] + [(170, longer), (171, longer), (172, "ha " * 400), (173, "ha " * 300), (174, "ha " * 49)]
    out += [(180, None), (181, ""), (182, " \n\t "), (183, "a <P> b"), (184, "<M>"), (185, "é" * 700_000 + "ü🙂" * 10_000), (186, text(20_000)), (171, shared), (171, longer), (3, None)]
    out += [out[5], out[5], (None, longer), (None, shared), (None, None), (None, None)]
    lang = lambda k: None if k % 11 == 0 else ["en", "de", "fr"][k % 3] if k % 5 else f"l{k % 10}"
    return [(i, t, lang(k), f"s{k % 4}" if k % 7 else None, k if k % 6 else None, 1, "t", 2, "p", "f") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tree(level: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node and per leaf the siblings before and after, upwards."""
    owners, paths = [[i] for i in range(len(level))], [[] for _ in level]
    while len(level) > 1:
        runs = [range(a, min(a + 8, len(level))) for a in range(0, len(level), 8)]
        for run in runs:
            for i in run:
                for leaf in owners[i]:
                    paths[leaf].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        level, owners = [sha("".join(level[i] for i in run)) for run in runs], [[x for i in run for x in owners[i]] for run in runs]
    return level[0], paths


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def test_manifest(docs, rows, nothing):
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by_lang = {}
    for r in rows:
        shown = low(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), leaf_of(r, shown), r[0]))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by_lang[name].sort(key=lambda x: x[:4])
        trees[name] = tree([x[2] for x in by_lang[name]])
    root, over = tree([trees[name][0] for name in names])
    want = Counter()
    for name, above in zip(names, over, strict=True):
        for x, path in zip(by_lang[name], trees[name][1], strict=True):
            digest = x[3]
            for before, after in [*path, *above]:
                digest = sha(before + digest + after)
            proof = sha("".join(a + b for a, b in [*path, *above]))
            want[x[4], x[2], trees[name][0], root, proof, digest, digest == root] += 1
    got = manifest.proofs(docs, manifest.lowered_thirds()).select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("p"), "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == want
    assert len({r.verified for r in got}) == 2
    assert all(r.verified for r in manifest.proofs(docs).select("verified").collect())
    assert manifest.proofs(nothing).count() == 0
    single = manifest.proofs(docs.where("doc_id = 170")).select("leaf", "subroot", "root", F.size("path").alias("n")).collect()
    assert [(r.leaf == r.subroot == r.root, r.n) for r in single] == [(True, 0)]


def test_intervals(docs):
    nodes, built, _ = manifest.manifest(manifest.leaves(docs))
    assert nodes.groupBy("tree").agg(F.count("*").alias("c"), F.countDistinct("lo").alias("d"), F.max("lo").alias("m"), F.max("n").alias("n")).where("c <> d OR m <> c - 1 OR n <> c").count() == 0
    for level, rows in enumerate(built, 1):
        assert rows.where((F.col("lo") % manifest.width(level) != 0) | (F.col("hi") <= F.col("lo")) | (F.size("children") != F.ceil((F.col("hi") - F.col("lo")) / manifest.width(level - 1)))).count() == 0


def brute_repeats(rows):
    place = lambda i: (i is None, i or 0)
    least = {}
    for r in rows:
        w = words(r[1])
        for a in range(len(w) - 49):
            s = tuple(w[a : a + 50])
            least[s] = min(least.get(s, (True, 1)), place(r[0]))
    want = Counter()
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if least[tuple(w[a : a + 50])] < place(r[0]):
                gone[a : a + 50] = [True] * 50
        want[r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    return want


@pytest.mark.parametrize(("hot", "chunk_bytes"), [(64, 16 << 20), (0, 4096), (3, 16 << 20)])
def test_fixed_blocks(docs, rows, nothing, hot, chunk_bytes):
    got = anchors.without_repeats(docs, hot, chunk_bytes).collect()
    want = brute_repeats(rows)
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_removed for r in got) > 1000
    assert anchors.without_repeats(nothing).count() == 0
    assert anchors.without_repeats(docs.where("text IS NULL")).agg(F.sum("n_words")).first()[0] == 0


def test_surroundings_do_not_depend_on_the_place():
    text = " ".join(f"w{i}" for i in range(200))
    chunk = anchors.Chunk(pa.table({"doc_id": pa.array([1, 2]), "text": ["a b " + text, text]}))
    first, second = 2 + 50, 202 + 50
    assert chunk.surroundings(np.array([first, second])).tolist()[0] == chunk.surroundings(np.array([second])).tolist()[0]
    assert len(set(chunk.surroundings(np.array([first, first + 1])).tolist())) == 2


def test_fill_in_middle(docs, rows, nothing):
    want = Counter()
    for r in rows:
        t = r[1] or ""
        h = sha("1:" + ("" if r[0] is None else str(r[0])))
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        n = len(t)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want[r[0], n, "plain", None, None, t] += 1
        elif h4 % 100 < 20:
            want[r[0], n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"] += 1
        else:
            want[r[0], n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"] += 1
    made = fill_middle.transformed(docs)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "tree", "lo", "pid", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(nothing).count() == 0


def test_fill_in_middle_of_lines(docs, rows):
    made = fill_middle.transformed(docs, plain_percent=0, kind="lines").withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    for r in made:
        text = r.text or ""
        assert r.back == text
        if r.form != "plain":
            borders = {0, len(text)} | {i + 1 for i, c in enumerate(text) if c == "\n"}
            assert r.prefix_chars in borders and r.prefix_chars + r.middle_chars in borders
            assert r.n == len(text.split("\n")) - text.endswith("\n")
    with pytest.raises(ValueError, match="units"):
        fill_middle.transformed(docs, kind="bytes")


def test_stages_keep_columns_of_any_name(spark):
    names = "doc_id long, text string, source string, h string, `check` string, _size string, _id string, whole string, size string, m string, copies string, words string, number string"
    given = [(i, f"{i % 7} " * 30 + "x y z", f"s{i % 2}", *[f"{c}{i}" for c in "abcdefghij"]) for i in range(40)]
    given += [given[0], given[0]]
    docs = spark.createDataFrame(given, names)
    for stage in (jaccard.one_of_each, mixing.mixed):
        out = stage(docs)
        rows = set(map(tuple, out.collect()))
        assert out.columns == docs.columns and rows and rows <= set(given)
    assert len(jaccard.one_of_each(docs).collect()) == 7


def test_forest_of_spanning_links():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(2, 30)
        edges = {(i, j) for i in range(n) for j in range(i) if rng.random() < 0.15}
        pairs = [(i, j) for i in range(n) for j in range(i)]
        root = [rng.randrange(n) for _ in range(n)]
        found = jaccard.spanning(pairs, root, lambda i, j: (i, j) in edges)

        def classes(links, root=root, n=n):
            name = list(range(n)) + [n + r for r in root]
            for a, b in [*links, *((i, n + i) for i in range(n)), *((n + i, n + j) for i in range(n) for j in range(n) if root[i] == root[j])]:
                old, new = name[a], name[b]
                name = [new if x == old else x for x in name]
            return {frozenset(i for i in range(n) if name[i] == x) for x in name}

        assert set(found) <= edges and len(found) < n and classes(found) == classes(edges)
