"""Patch text, checked on hand-made patches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patchloom.functions import patches

P = F.col("p")


def test_lines_follow_all_separators(one):
    assert one(patches.patch_lines(P), p="a\r\nb\rc\x0bd\u2028e\n") == ["a", "b", "c", "d", "e"]
    assert one(patches.patch_lines(P), p="a\n\n") == ["a", ""]
    assert one(patches.patch_lines(P), p="") == []
    assert one(patches.patch_lines(P), p=None) is None


@pytest.mark.parametrize(
    ("patch", "code"),
    [
        ("+++ b/f\n--- a/f\n@@ -1 +1 @@\n+    if x:\n+        y()\n-old\n ctx", "if x:\n    y()"),
        ("+++i\n+j", "j"),  # an added line starting with '++' reads as a header
        ("+\tx\n+  y", "\tx\n  y"),  # no shared indent
        ("+  a\n+   \n+  b", "a\n\nb"),  # blank lines are emptied and do not count
        (" only context", ""),
        ("+a\r\n+b", "a\nb"),
        ("+  a\n+\n+    b", "a\n\n  b"),
    ],
)
def test_added_code(one, patch, code):
    assert one(patches.added_code(P), p=patch) == code


def test_old_and_new_code(one):
    patch = "--- a\n+++ b\n@@ -1,3 +1,3 @@\n keep\n-gone\n+come\nbare\n\n"
    assert one(patches.old_code(P), p=patch) == "keep\ngone\nbare\n\n"
    assert one(patches.new_code(P), p=patch) == "keep\ncome\nbare\n\n"
    assert one(patches.old_code(P), p="") is None


def names(one, patch, language, sign="+", kind="functions"):
    fn = patches.function_names if kind == "functions" else patches.class_names
    return sorted(one(fn(P, F.lit(language), sign), p=patch))


def test_function_names_by_language(one):
    assert names(one, "+def a(x):\n+    def b():\n-def c():\n+def a(y):", "python") == ["a"]
    assert names(one, "+def a(x):\n-def c():", "python", "-") == ["c"]
    ts = "+function f(a) {\n+const g = (x) => x\n+let h: Fn = y => y\n+const k = 3\n+ const m = () => 1\n+export const n = () => 1"
    assert names(one, ts, "typescript") == ["f", "g", "h: Fn"]
    assert names(one, "+func run(a int) {\n+func (t *T) method() {", "go") == ["run"]
    assert names(one, "+function f() {", "javascript") == []
    assert names(one, None, "python") == []
    assert names(one, "+def a():", None) == []


def test_class_names_by_language(one):
    assert names(one, "+class A(B):\n+class C:\n+    class D:", "python", kind="classes") == ["A", "C"]
    assert names(one, "+class A extends B {\n+class C{", "typescript", kind="classes") == ["A extends B", "C"]
    assert names(one, "+class A {", "go", kind="classes") == []


def test_simple_variants_cut_at_the_next_keyword(one):
    patch = "+def undefined(a):\n+def ok(a):\n+def ok(b):\n+defer(x)\n-def out():"
    assert one(patches.simple_functions(P, "+"), p=patch) == ["un", "ok", "ok", "er"]
    assert one(patches.simple_functions(P, "-"), p=patch) == ["out"]
    assert one(patches.simple_classes(P, "+"), p="+class A(B):\n+class C:") == ["A(B)", "C"]


def test_unsupported_file_is_reported(spark):
    df = spark.createDataFrame([("+def a():", "x.rb"), ("+def a():", "d/x.PY"), (None, "x.py")], "p STRING, f STRING")
    rows = df.select(*patches.checked_changes(P, F.col("f"))).collect()
    assert [r.error for r in rows] == ["Language not supported: x.rb", None, None]
    assert [r.added_functions for r in rows] == [[], ["a"], []]


def test_symbol_changes_compare_both_versions(spark):
    patch = "@@\n def keep():\n-def old():\n+def new():\n class Box:\n+    def put(self):"
    df = spark.createDataFrame([(patch, "m.py")], "p STRING, f STRING")
    row = df.select(patches.symbol_changes(P, F.col("f")).alias("s")).select("s.*").first()
    assert row.language == "python"
    assert sorted(row.added_functions) == ["new", "put"]
    assert row.removed_functions == ["old"]
    assert row.added_classes == [] and row.removed_classes == []


def definitions(one, code, language):
    found = one(patches.definitions(P, language), p=code)
    return found.classes, found.functions


def test_definitions_leave_methods_out(one):
    python = "def mill(grain):\n    def sieve():\n        pass\n\nclass Oven:\n    def heat(self):\n        pass\n\nclass Tray:\n    size = 4\ndef serve(): pass"
    assert definitions(one, python, "python") == (["Oven", "Tray"], ["mill", "sieve", "serve"])
    js = """
    class Kettle {
      boil() {
        const hiss = (loud) => {
        };
      }
    }
    const pour = (cup) => {
      return cup;
    };
    function steep(leaf, minutes) {
      return leaf;
    }
    """
    assert definitions(one, js, "javascript") == (["Kettle"], ["pour", "steep"])
    rust = "struct P {\n}\nimpl P {\n    fn m(&self) {}\n}\npub fn free() {\n}"
    assert definitions(one, rust, "rust") == (["P"], ["free"])
    cpp = "class Lamp {\npublic:\n    void dim() {\n    }\n};\nint watts(int lamps, int each) {\n    return lamps * each;\n}\n"
    assert definitions(one, cpp, "cpp") == (["Lamp"], ["watts"])
    assert definitions(one, "x", "cobol") == ([], [])


def test_definitions_with_headers_over_several_lines(one):
    python = "class Box(\n    Base,\n    Other,\n):\n    def put(self):\n        pass\n\ndef take(\n    a,\n):\n    def inside():\n        pass"
    assert definitions(one, python, "python") == (["Box"], ["take", "inside"])


def test_definitions_without_a_body_open_no_block(one):
    assert definitions(one, "class Node;\nint size(int a) {\n    return a;\n}", "cpp") == (["Node"], ["size"])
    assert definitions(one, "struct Unit;\nstruct Pair(i32, i32);\nfn free() {\n}", "rust") == (["Unit", "Pair"], ["free"])


def test_braces_in_texts_and_comments_are_no_blocks(one):
    js = "class Doc {\n  open() {\n    return '{';\n  } // {\n}\nfunction close() {\n  return `}`;\n}"
    assert definitions(one, js, "javascript") == (["Doc"], ["close"])
    rust = "impl<'a> View<'a> {\n    fn at(&self) -> char { '{' }\n}\nfn free<'a>(x: &'a str) {\n}"
    assert definitions(one, rust, "rust") == ([], ["free"])


def test_texts_and_comments_over_lines_define_nothing(one):
    python = 'def plan():\n    """Use it so:\n\ndef ghost():\n    """\n\nclass Map:\n    x = \'\'\'\nclass Fake:\n\'\'\'\n    def at(self): pass  # def no():\n\ndef route(): pass'
    assert definitions(one, python, "python") == (["Map"], ["plan", "route"])
    js = "/* function ghost() {\nfunction other() {\n*/ function real() {\n}\nconst page = `\nclass Fake {\n`;\nfunction next() {\n  return /[\"'`]/.test(x);\n}\nfunction last() {\n}"
    assert definitions(one, js, "javascript") == ([], ["real", "next", "last"])
    go = "var q = `\nfunc ghost() {\n`\nfunc real() rune {\n\treturn '\"'\n}\nfunc next() {}"
    assert definitions(one, go, "go") == ([], ["real", "next"])
    cpp = 'auto t = R"x(\nclass Fake {\n)" )x";\nclass Lens { // {\n  int f() { return \'"\'; }\n};\nint real(int a) {\n}'
    assert definitions(one, cpp, "cpp") == (["Lens"], ["real"])
    sharp = 'var t = @"\nclass Fake { "" \n";\npublic class Lamp {\n}\n/*\nclass Other {\n*/\nclass Wick {\n}'
    assert definitions(one, sharp, "c_sharp") == (["Lamp", "Wick"], [])
    rust = 'let t = r#"\nfn ghost() { "\n"#;\nlet u = "\nfn other() {\n";\nfn real<\'a>(x: &\'a str) {\n}\nfn next() {\n}'
    assert definitions(one, rust, "rust") == ([], ["real", "next"])


def test_marks_that_are_never_closed_hide_nothing(one):
    assert definitions(one, 'def a():\n    """open\n\ndef b(): pass', "python") == ([], ["a", "b"])
    assert definitions(one, "/* open\nfunction a() {\n}\nlet s = `open;\nfunction b() {\n}", "javascript") == ([], ["a", "b"])
    assert one(patches.code_only(P, "cobol"), p="x 'y'") == "x 'y'"


def test_very_long_texts_are_left_out(one):
    code = 'x = """' + 'def ghost(): \\" pass\n' * 20000 + '"""\ndef real(): pass\ny = "' + "\\n " * 50000 + '"'
    assert definitions(one, code, "python") == ([], ["real"])


def test_symbol_changes_outside_texts_and_comments(spark):
    patch = "@@\n+/*\n+function ghost() {\n+*/\n+function real() {\n-class Old {\n+const t = `\n+class Fake {\n+`;"
    df = spark.createDataFrame([(patch, "m.mjs")], "p STRING, f STRING")
    row = df.select(patches.symbol_changes(P, F.col("f")).alias("s")).select("s.*").first()
    assert (row.language, row.added_functions, row.removed_functions) == ("javascript", ["real"], [])
    assert (row.added_classes, row.removed_classes) == ([], ["Old"])
