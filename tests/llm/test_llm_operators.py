"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeats, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import decontaminate, html, jaccard, language_model, mixing, quality, quotes, sharding, suffixes, token_counts
from patchloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, copies string"
SPACES = " \t\n\v\f\r"


def words(text: str | None) -> list[str]:
    out = [""]
    for c in text or "":
        out = [*out, ""] if c in SPACES and out[-1] else out if c in SPACES else [*out[:-1], out[-1] + c]
    return [w for w in out if w]


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    some = ["the", "of", "Ärger", "and", "thonwh", "ering!", "la", "née", "x|y", "0"]
    text = lambda n: " ".join(rng.choice(some) + rng.choice(["", "", "s", "ed"]) + rng.choice(["", "\n", "."]) for _ in range(n))
    base = text(120)
    near = base.split(" ")
    out = [(i, text(rng.choice([1, 2, 3, 40, 200]))) for i in range(30)]
    out += [(100 + i, base) for i in range(4)] + [(110 + i, " ".join([*near[:i], "new", *near[i + 1 :]])) for i in range(3)]
    out += [(120, None), (121, ""), (122, " \n\t "), (123, "one"), (124, "One"), (125, "ha " * 3000), (126, base + " " + text(50)), (130, text(20_000)), (110, " ".join([*near[:2], "x", *near[3:]])), (7, None)]
    out += [out[0], out[0]]
    return [(i, t, "en", None if k % 9 == 0 else f"s{k % 4}", 1, "e", "c") for k, (i, t) in enumerate(out)] + [(None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_mixing(docs, rows, nothing):
    got = mixing.planned(docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(sum(weight[s] for s in free), 1)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(3 * sizes[r.source] if r.source in capped else level * weight[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    for s in names:
        largest = max(r.size for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 3 * largest
    assert sorted(map(str, got)) == sorted(map(str, mixing.planned(docs.repartition(2)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.planned(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def test_rounding_keeps_expectations(spark):
    sizes = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), (F.col("id") % 17 + 1).alias("size"))
    total = Counter()
    for seed in range(6):
        for r in mixing.copies(sizes, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect():
            assert abs(r.taken - r.target) <= 17
            total[r.source] += r.most
    assert total["0"] < total["1"]


def test_suffix_dedup(docs, rows, nothing):
    seen, want = set(), Counter()
    for i, t in sorted(((r[0], (r[1] or "").encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        gone = bytearray(len(t))
        for at in range(len(t) - 99):
            w = t[at : at + 100]
            if w in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        want[i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    for hot in (5000, 1):
        suffixes.HOT = hot
        got = suffixes.without_repeats(docs).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == want
        assert all(sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed for r in got)
    suffixes.HOT = 5000
    assert suffixes.without_repeats(nothing).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 9):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 12))) for _ in range(n)]
        got = list(suffixes.merged([suffixes.decoded(*suffixes.front_coded(r)) for r in runs] or [iter(())]))
        assert [g[0] for g in got] == sorted(s for r in runs for s in r)
        assert all(b[1] == suffixes.common(a[0], b[0]) for a, b in zip(got, got[1:], strict=False))


def test_decontamination(spark, docs, rows, nothing):
    long = next(r[1] for r in rows if r[0] == 130)
    items = [(1, " ".join(words(long)[50:75])), (2, "née la"), (10, None), (11, ""), (12, "zzz qqq"), (2, "ONE"), (None, "ha ha ha ha")]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, n_words string")
    tokens = lambda t: "".join(c if c >= "\x80" or c.isalnum() else " " for c in lower(t)).split(" ")
    tokens_ = lambda t: [w for w in tokens(t) if w]
    patterns = [(i, w[k : k + min(10, len(w))]) for i, t in items if (w := tokens_(t)) for k in range(max(1, len(w) - 9))]
    want = Counter()
    for r in rows:
        w, hit, found = tokens_(r[1]), set(), set()
        text = " ".join(w)
        for i, p in patterns:
            if " ".join(p) in text:
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= set(range(k, k + len(p)))
                        found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        want[r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    for block in (20_000, 1):
        decontaminate.BLOCK_WINDOWS = block
        got = decontaminate.contamination(docs, bench)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
        kept = decontaminate.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(n for x, n in want.items() if not x[-1])
    decontaminate.BLOCK_WINDOWS = 20_000
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count()
    assert decontaminate.contamination(nothing, bench).count() == 0


def test_sharding(docs, rows, nothing):
    got = sharding.sharded(docs, shards=4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.sharded(nothing).count() == 0


def test_sharding_balance_and_movement(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("t"), F.col("id") % 2500)).alias("text"))
    one, two = ({r.doc_id: r for r in sharding.sharded(docs, n).collect()} for n in (8, 9))
    load = Counter()
    for r in one.values():
        load[r.shard] += r.size
    assert max(load.values()) <= 1.02 * min(load.values())
    homes = {}
    for r in one.values():
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(b"hot " * 20)
    assert all(len(s) == 1 for c, s in homes.items() if c != hot) and len(homes[hot]) > 1
    assert sum(one[i].shard == two[i].shard for i in one) > len(one) / 2


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, rows, nothing, width, percent):
    sets = []
    for r in rows:
        w = words(lower(r[1]))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                above[root(i)] = root(j)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        want[r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]] += 1
    got = jaccard.near_duplicates(docs, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.near_duplicates(nothing, width, percent).count() == 0


def test_one_of_each_group_stays(docs, rows):
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[100] == 1 and not any(ids[i] for i in (101, 102, 103, 110, 111, 112)) and ids[0] == 1 and ids[120] == 1


def test_one_of_each_decides_by_row(spark, rows):
    """Copies without doc_id go, too; texts that share a doc_id are decided one by one."""
    texts = {r[0]: r[1] for r in rows if r[1] and len(words(r[1])) > 30}
    a, b, c, d, e = [texts[i] for i in sorted(i for i in texts if i is not None and i < 30)][:5]
    given = [(1, a), (None, a), (2, a), (2, b), (3, c), (3, d), (None, e), (None, e), (None, None), (None, None), (4, None), (5, b), (3, c)]
    docs = spark.createDataFrame([(*x, str(i)) for i, x in enumerate(given)], "doc_id long, text string, extra string").repartition(3)
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, None), (None, None), (4, None)])
    assert sorted(map(str, left.collect())) == sorted(map(str, jaccard.one_of_each(docs.repartition(2)).collect()))


def test_bands_hold_all_links():
    for percent in (50, 80, 90):
        low, differ, parts = jaccard.bands(percent)
        for n in range(1, 400):
            band = np.searchsorted(low, n, "right") - 1
            for m in range(math.ceil(n * percent / 100), n + 1):
                other = np.searchsorted(low, m, "right") - 1
                assert other in (band, band - 1)
                least = math.ceil(percent * (n + m) / (100 + percent))
                assert n + m - 2 * least <= differ[band] and (parts[band] > differ[band] or differ[band] == 0)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 430)] + [(5, 5)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo += near[x]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if near[k] != {k}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body class="page sidebar-left"><header><h1>Site</h1></header>
    <nav><a href="/">menu</a></nav><div class="cookie-notice">We use cookies</div><div><article><header><h1>Head&amp;line</h1></header><p><b>First,   long
    paragraph</b>, with commas, and more<br>text<p>Second &eacute; &#233;<!-- no --><ul><li>one<li>two</ul><form>Name<input></form><div class="ad">Buy</div>
    <table><tr><td>cell<td>next</table><section id="comments"><p>Nice, text, indeed, yes, I say</section></article><aside>side</aside></div><footer>foot</footer></body></html>"""
    assert html.main_text(page) == "Head&line First, long paragraph, with commas, and more text Second é é one two cell next"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("only text, no tags") == "only text, no tags"
    assert html.main_text("</div></p><p>a<div>b") == "a b"
    assert len(html.main_text("<div>" * 3000 + "x" * 100_000)) == 100_000


def test_html_siblings():
    body = " ".join(f"<p>Paragraph {i}, with some words, and more of them to read here.</p>" for i in range(20))
    inner = " ".join(f"Paragraph {i}, with some words, and more of them to read here." for i in range(20))
    page = f"""<body><ul><li><a href="/">Home</a></ul><div><h1>T</h1><p>intro</p>bare text<div class=body>{body}</div><p>closing</p><p><a href="/x">more to read</a></p>
    <section><h2>Part two</h2><p>A short one.</p><p>Another, shorter one.</p></section><div><a href="/a">Next</a> <a href="/b">Last</a></div><div>x</div></div></body>"""
    assert html.main_text(page) == f"T intro bare text {inner} closing Part two A short one. Another, shorter one."


def test_html_names_and_wrappers():
    """Values are no names; names of what a page has, and wrappers of the whole page, delete nothing."""
    text = " ".join(f"<p>Paragraph {i}, with some words, and more of them to read here.</p>" for i in range(6))
    inner = " ".join(f"Paragraph {i}, with some words, and more of them to read here." for i in range(6))
    link = '<p>See <a href="/hidden-gems" title="The hidden truth">gems</a> and <a href="/page?id=footer">the page</a>.</p>'
    assert html.main_text(f"<article>{text}{link}</article>") == f"{inner} See gems and the page."
    for name in ("content has-sidebar", "no-sidebar", "sidebar-left", "elementor-widget-container", "page-header"):
        for body in (f"<article>{text}</article>", text):
            assert html.main_text(f'<div class="{name}">{body}<div class="sidebar">Other, text, here</div></div>') == inner
    assert html.main_text("<article>" + "".join(f'<div class="x-widget x-widget-text"><p>{i} is told</p></div>' for i in range(5)) + "</article>") == "0 is told 1 is told 2 is told 3 is told 4 is told"
    assert html.main_text(f'<form id="aspnetForm"><div>{text}</div></form>') == inner
    assert html.main_text(f'<div>{text}<form>Your name</form><p data-x="hidden">last</p><p hidden>no</p><p style="display:none">no</p></div>') == f"{inner} last"
    assert html.main_text(f'<article><header class="entry-header"><h1>T</h1></header><p>Short</p></article><div class="related">{text}</div>') == "T Short"
    assert html.main_text(f'<div><p>Short, but told.</p></div><div id="comments">{text}</div>'.replace("Short", "Short, " * 3)) == "Short, Short, Short, , but told."


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x, y</p>", "t"), (None, None, None, None), (1, "u", "<p>x, y</p>", "t")], "page_id long, url string, html string, n_chars string")
    assert sorted(map(str, ((r.page_id, r.url, r.text, r.n_chars) for r in html.extracted(pages).collect()))) == ["(1, 'u', 'x, y', 4)", "(1, 'u', 'x, y', 4)", "(None, None, '', 0)"]
    assert html.extracted(pages.limit(0)).count() == 0


def test_language_model(docs, rows, nothing):
    tokens = [[*words(lower(r[1])), "\0end"] for r in rows]
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 5 == 1 for r in rows]
    c = Counter(t for ts, h in zip(tokens, held, strict=True) for t in ts if not h)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), h, len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)) for r, h, ts in zip(rows, held, tokens, strict=True))
    got = language_model.scored(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert language_model.scored(nothing).count() == 0


def test_network_gradient_and_state():
    rng = np.random.default_rng(0)
    network = language_model.Network()
    before, codes = rng.integers(0, 64, (4, 3)), rng.integers(0, 64, (4, 3))
    fresh, live, h = np.zeros((4, 3), bool), np.ones((4, 3), bool), rng.normal(size=(3, language_model.HIDDEN)).astype(np.float32)
    fresh[2, 1] = True
    loss = lambda: -network.log_shares(network.forward(before, fresh, h)[0])[np.arange(12), codes.ravel()].mean()
    network.vector[:] = network.vector.astype(np.float32)
    grad, _ = network.gradient(before, fresh, codes, live, h)
    for i in np.argsort(-abs(grad))[:40:4]:
        kept = network.vector[i]
        network.vector[i] = kept + 1e-2
        up = loss()
        network.vector[i] = kept - 1e-2
        down = loss()
        network.vector[i] = kept
        assert (up - down) / 2e-2 == pytest.approx(grad[i], rel=0.08, abs=2e-4)
    texts = [rng.integers(0, 64, n).astype(np.uint8) for n in (1, 5, 70, 200)]
    together = language_model.log_likelihood(network, texts)
    assert together == pytest.approx([language_model.log_likelihood(network, [t])[0] for t in texts], rel=1e-4)


def test_quotes(spark):
    rows = [
        (1, 0, "a", "First line here.\nSecond thought!"), (1, 1, "b", "Bob wrote:\n> first LINE here\nI agree"), (1, 2, "c", "> I agree\n>> First line here.\nBoth"), (1, 3, "d", "alone"),
        (1, 4, "e", "> nobody said this\nok"), (2, 0, "f", "I agree"), (1, 4, "e", "> nobody said this\nok"), (None, None, None, None), (None, 5, "g", "> I agree"), (3, None, "h", "x"), (1, 5, "i", ">>> ok\n> \nfine"),
    ]
    got = quotes.linked(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, thread string")).collect()
    of = {(r.conv_id, r.turn): (r.text, r.n_quoted, r.n_linked, r.levels, r.reply_to, r.thread, r.depth) for r in got}
    assert len(got) == len(rows)
    assert of[1, 0] == ("First line here.\nSecond thought!", 0, 0, 0, None, 0, 0)
    assert of[1, 1] == ("I agree", 1, 1, 1, 0, 0, 1)
    assert of[1, 2] == ("Both", 2, 2, 2, 1, 0, 2)
    assert of[1, 3] == ("alone", 0, 0, 0, None, 3, 0) and of[2, 0] == ("I agree", 0, 0, 0, None, 0, 0)
    assert of[1, 4] == ("ok", 1, 0, 1, None, 4, 0) and of[1, 5] == ("fine", 1, 1, 3, 4, 4, 1)
    assert of[None, 5][1:3] == (1, 0) and of[None, None][0] == ""
    assert quotes.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_of_passages(spark):
    """Passages match whatever their line breaks; the latest original wins; what has no original stays in kept_text."""
    long = "The build fails on the second machine because its disk is full. Please clear the old logs before you start it again, thanks."
    rows = [
        (1, 0, long), (1, 1, "> The build fails on the\n> second machine because its\n> disk is full.\nWhich disk?"), (1, 2, "Ann wrote:\n> Please clear the old logs before you start it again\nDone."),
        (1, 3, "thanks"), (1, 4, "ok\nthanks"), (1, 5, "> thanks\nwelcome"), (1, 6, ">>> print(1)\n> a word of some other source entirely\nHe wrote:\nthe end"),
        (1, 7, "> Which disk?\n> Done.\n>\n> nothing of the kind was said here\nyes"), (2, 0, "今天天气很好我们去公园"), (2, 1, "> 天气很好\n> 我们去\n好"), (3, 0, "a b c d e f g"), (3, 1, "> b c d e f x\nno"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [(r.reply_to, r.n_quoted, r.n_linked) for r in (got[1, i] for i in (1, 2, 5, 6, 7))] == [(0, 3, 3), (0, 1, 1), (4, 1, 1), (None, 2, 0), (2, 3, 2)]
    assert (got[1, 1].kept_text, got[1, 2].kept_text, got[1, 5].kept_text, got[1, 2].thread, got[1, 7].depth) == ("Which disk?", "Done.", "welcome", 0, 2)
    assert got[1, 6].kept_text == rows[6][2] and got[1, 6].text == "He wrote:\nthe end"
    assert got[1, 7].kept_text == ">\n> nothing of the kind was said here\nyes"
    assert (got[2, 1].reply_to, got[2, 1].kept_text) == (0, "好") and (got[3, 1].reply_to, got[3, 1].kept_text) == (None, "> b c d e f x\nno")


def test_quality(docs, rows, labels, nothing):
    def base(text):
        w = words(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)

    got = quality.assess(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *base(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.assess(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality.assess(nothing, labels).count() == 0


@pytest.mark.parametrize("rare", [0, 1])
def test_forest_of_rare_labels(spark, rare):
    """The only row of a kind decides, though the sample by hash does not hold it."""
    rng = random.Random(3)
    last = spark.range(200).orderBy(F.xxhash64("id").desc()).first().id
    texts = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("#!9" if i == last else "") for _ in range(60))) for i in range(200)]
    stats = quality.rule_statistics(spark.createDataFrame(texts, "doc_id long, text string"))
    given = spark.createDataFrame([(i, rare if i == last else 1 - rare) for i in range(200)], "doc_id long, quality int")
    forest = quality.fit_forest(stats, given, 4, 16)
    assert forest is not None
    if not rare:
        assert not quality.judged(stats.where(F.col("doc_id") == last), forest).first().kept
    assert quality.fit_forest(stats, given.where(F.col("doc_id") != last), 4, 16) is None


def test_forest_finds_what_is_rare():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (900, 3)), rng.normal(7, 1, (100, 3))]).astype(np.float32)
    good = np.arange(1000) < 900
    score = quality.grow(x, good, 50, 256).score(x)
    assert (score[~good][:, None] > score[good][None, :]).mean() > 0.98


def test_token_counts(spark, docs, rows, nothing):
    counter = token_counts.Counter(open(token_counts.RANKS, "rb").read())
    edits = "array(struct(3 AS at, 5 AS drop, ' new text' AS put), struct(1000000 AS at, 1 AS drop, 'end' AS put), struct(0 AS at, 0 AS drop, CAST(NULL AS STRING) AS put), null)"
    state = token_counts.trees(docs.withColumn("edits", F.expr(edits)))
    want = Counter()
    for r in rows:
        t = r[1] or ""
        new = t[:3] + " new text" + t[8:] + "end" if len(t) >= 3 else t + " new text" + "end"
        want[r[0], new, len(counter.encoder.encode_ordinary(t)), len(counter.encoder.encode_ordinary(new)), 2] += 1
    got = token_counts.edited(state).collect()
    assert Counter((r.doc_id, r.text, r.n_before, r.n_tokens, r.n_edits) for r in got) == want
    assert all(r.n_encoded < 30 for r in got)
    assert token_counts.edited(token_counts.trees(token_counts.sample_edits(nothing))).count() == 0


def test_edited_trees_equal_new_ones():
    counter, rng = token_counts.Counter(open(token_counts.RANKS, "rb").read()), random.Random(5)
    letters = "ab c  d\n\n'll're 12,.!é Ä\t "
    for _ in range(400):
        now = token_counts.Edited.of("".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 300, 3000]))), counter)
        for _ in range(3):
            now.edit(rng.randint(0, len(now.text) + 3), rng.choice([0, 1, 5, 200]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 60]))))
            assert now.tree.leaves()[0] == [len(p) for p in counter.pieces(now.text)] and now.tree.total == len(counter.encoder.encode_ordinary(now.text))
