"""Scalar functions."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from patchloom.functions import paths, text, times, vectors

T = F.col("t")


@pytest.mark.parametrize(
    ("path", "ext"),
    [("a/b.PY", ".py"), (".bashrc", ""), ("a/.env.ts", ".ts"), ("Makefile", ""), ("a.b/c", ""), ("x.tar.gz", ".gz"), ("..py", "")],
)
def test_extension(one, path, ext):
    assert one(paths.extension(T), t=path) == ext


def test_path_parts(one):
    assert one(paths.module_l1(T), t="a/b/c.py") == "b"
    assert one(paths.module_l2(T), t="a/b/c.py") == "a"
    assert one(paths.module_l2(T), t="b/c.py") is None
    assert one(paths.module_l1(T), t="c.py") is None
    assert one(paths.repo_full_name(T), t="https://x.example/repos/own/rep") == "own/rep"
    assert one(paths.recode(T, {"a": "b"}), t="zzz") is None
    assert one(paths.recode(T, {"a": "b"}), t=None) is None


def test_words_and_blanks(one):
    assert one(text.word_count(T), t=" a\u00a0b\u2003c\nd ") == 4
    assert one(text.word_count(T), t=None) is None
    assert one(text.has_text(T), t=" \u00a0\n") is False
    assert one(text.has_text(T), t=None) is False
    assert one(text.strip(T), t="\u2003x y\x1c") == "x y"


def test_issue_links(one):
    assert one(text.issue_links(T), t="Fixes #12, closes BUG-7; related to: ab-3 fixes nothing") == [
        "Fixes #12",
        "closes BUG-7",
        "related to: ab-3",
    ]
    assert one(text.has_issue_link(T), t=None) is False


def test_headings_count_spellings_apart(one):
    body = "## Summary\n# SUMMARY\nMotivation x\nno Context\n\n   Checklist"
    assert sorted(one(text.template_headings(T), t=body)) == ["Checklist", "Motivation", "SUMMARY", "Summary"]
    assert one(text.template_headings(T), t=None) == []


def test_checklist_flag_is_true_for_every_text_unless_fixed(one):
    assert one(text.has_checklist(T), t="nothing here") is True
    assert one(text.has_checklist(T), t=None) is False
    assert one(text.has_checklist(T, fixed=True), t="nothing here") is False
    assert one(text.has_checklist(T, fixed=True), t="x\n - [x] done") is True
    # a carriage return alone does not start a line
    assert one(text.has_checklist(T, fixed=True), t="x\r- [x] done") is False


def test_code_fences(one):
    assert one(text.code_snippets(T), t="a ```py\n x = 1 \n``` b ```y```") == ["x = 1", ""]
    assert one(text.code_snippets(T), t=None) == []


def test_render_never_reads_inserted_text(one):
    out = one(text.render("A {t} B {u}", t=T, u=F.lit("{t}")), t="{u}")
    assert out == "A {u} B {t}"


def test_gaps(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1))], "a TIMESTAMP, b TIMESTAMP"
    )
    row = df.select(
        times.gap_days(F.col("a"), F.col("b")).alias("d"),
        times.gap_days(F.col("b"), F.col("a")).alias("back"),
        times.gap_hours(F.col("a"), F.col("b")).alias("h"),
    ).first()
    assert (row.d, row.back, row.h) == (0, -1, 2.0)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 3.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0])
