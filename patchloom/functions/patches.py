"""Unified-diff text as column expressions.

Every extraction is one regular-expression scan over the patch. A "line start" is
the start of the text or the place after a line separator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchloom.functions.paths import SYMBOL_LANGUAGES, language_of
from patchloom.functions.text import strip

# The characters that end a line, written so that the class stays a bit set.
BREAKS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}-\x{2029}"
LINE_START = rf"(?:\A|(?<=[{BREAKS}]))"


def _at_line_start(literal: str) -> str:
    """The escaped literal at a line start; the literal leads, so the scan jumps to its hits."""
    return rf"{literal}(?<=(?:\A|[{BREAKS}]){literal})"


NO_NAMES = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_NAMES)


def _extract(patch: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(patch, F.lit(pattern), F.lit(group))


def _clean(names: Column) -> Column:
    """Trim each name and drop the empty ones."""
    return F.filter(F.transform(names, strip), lambda n: n != "")


def patch_lines(patch: Column) -> Column:
    """Lines of the patch; a final separator does not open another line."""
    parts = F.split(patch, rf"\r\n|[{BREAKS}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def dedent(code: Column) -> Column:
    """Remove the leading blanks and tabs all non-blank lines share; blank lines become ''.

    The shared part of all indents is the shared prefix of the smallest and the largest one.
    """
    flat = F.regexp_replace(code, r"(?dm)^[ \t]+$", "")
    indents = _extract(flat, r"(?dm)^([ \t]*)[^ \t\n]")
    ends = F.concat(F.array_min(indents), F.lit("\x01"), F.array_max(indents))
    shared = F.coalesce(F.regexp_extract(ends, r"\A([ \t]*)[ \t]*\x01\1", 1), F.lit(""))
    return F.regexp_replace(flat, F.concat(F.lit("(?dm)^"), shared), F.lit(""))


def added_code(patch: Column) -> Column:
    """Added lines without the marker, dedented. A line added as '++…' reads as a header and is left out."""
    lines = _extract(patch, rf"{LINE_START}\+(?!\+\+)([^{BREAKS}]*)")
    return dedent(F.array_join(lines, "\n"))


def _version(patch: Column, other_side: str) -> Column:
    lines = _extract(patch, rf"(?:\A|(?<=\n))(?!---|\+\+\+|@@|{other_side})[-+ ]?([^\n]*)")
    return F.when(patch != "", F.array_join(lines, "\n"))


def old_code(patch: Column) -> Column:
    """Removed and context lines; null for a missing or empty patch."""
    return _version(patch, r"\+")


def new_code(patch: Column) -> Column:
    """Added and context lines; null for a missing or empty patch."""
    return _version(patch, "-")


def _prefixed(patch: Column, sign: str, keyword: str, stop: str) -> Column:
    return _extract(patch, rf"{_at_line_start(rf'\{sign}{keyword} ')}([^{stop}{BREAKS}]*)")


def _arrow(patch: Column, sign: str, keyword: str) -> Column:
    head = rf"{_at_line_start(rf'\{sign}{keyword} ')}([^={BREAKS}]*)(?=[^{BREAKS}]*=>)(?==)"
    return F.transform(_extract(patch, head), lambda n: F.replace(n, F.lit(sign + keyword), F.lit("")))


def function_names(patch: Column, language: Column, sign: str) -> Column:
    """Distinct names of functions defined at the line start of '+' or '-' lines."""
    names = (
        F.when(language == "python", _prefixed(patch, sign, "def", "("))
        .when(
            language == "typescript",
            F.concat(
                _prefixed(patch, sign, "function", "("), _arrow(patch, sign, "const"), _arrow(patch, sign, "let")
            ),
        )
        .when(language == "go", _prefixed(patch, sign, "func", "("))
    )
    return F.coalesce(F.array_distinct(_clean(names)), _empty())


def class_names(patch: Column, language: Column, sign: str) -> Column:
    """Distinct names of classes defined at the line start of '+' or '-' lines."""
    names = F.when(language == "python", _prefixed(patch, sign, "class", "(:")).when(
        language.isin("javascript", "typescript"), _prefixed(patch, sign, "class", "{")
    )
    return F.coalesce(F.array_distinct(_clean(names)), _empty())


CHANGE_COLUMNS = ("added_functions", "added_classes", "removed_functions", "removed_classes")


def change_columns(patch: Column, language: Column) -> list[Column]:
    """The four name sets of a patch; all empty when patch or language is missing."""
    return [
        function_names(patch, language, "+").alias("added_functions"),
        class_names(patch, language, "+").alias("added_classes"),
        function_names(patch, language, "-").alias("removed_functions"),
        class_names(patch, language, "-").alias("removed_classes"),
    ]


def changes_of_file(patch: Column, filename: Column) -> list[Column]:
    """Four name sets for a file, safe on null and unsupported input."""
    return change_columns(patch, language_of(filename))


def checked_changes(patch: Column, filename: Column) -> list[Column]:
    """As ``changes_of_file`` with ``language`` and an ``error`` text for unsupported files."""
    language = language_of(filename)
    error = F.when(language.isNull(), F.concat(F.lit("Language not supported: "), F.coalesce(filename, F.lit(""))))
    return [language.alias("language"), error.alias("error"), *change_columns(patch, language)]


def combined_names(functions: Column, classes: Column) -> Column:
    """One list, functions first, each part in name order."""
    return F.concat(F.array_sort(functions), F.array_sort(classes))


def simple_functions(patch: Column, sign: str) -> Column:
    """Python names after ``+def`` / ``-def`` with repeats; the text is cut at the next 'def' as well."""
    return _clean(_extract(patch, rf"{_at_line_start(rf'\{sign}def')}((?:(?!def)[^({BREAKS}])*)"))


def simple_classes(patch: Column, sign: str) -> Column:
    """Python names after ``+class`` / ``-class`` with repeats; the list of bases stays in the name."""
    return _clean(_extract(patch, rf"{_at_line_start(rf'\{sign}class')}((?:(?!class)[^:{BREAKS}])*)"))


# Definitions by pattern, at any indentation. The name is group 1.
FUNCTION_PATTERNS = {
    "python": r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)",
    "javascript": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\*?[ \t]+(\w+)",
    "typescript": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\*?[ \t]+(\w+)",
    "go": r"(?m)^func[ \t]+(\w+)",
}
METHOD_PATTERN = (
    r"(?m)^[ \t]+(?:(?:public|private|protected|static|async)[ \t]+)*"
    r"(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|with\b|do\b|else\b)(\w+)[ \t]*\([^()]*\)[^;{}\n]*\{"
)
CLASS_PATTERNS = {
    "python": r"(?m)^[ \t]*class[ \t]+(\w+)",
    "javascript": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?class[ \t]+(\w+)",
    "typescript": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+)",
}


def _by_language(code: Column, language: Column, patterns: dict) -> Column:
    chain = None
    for name, pattern in patterns.items():
        found = _extract(code, pattern)
        if name in ("javascript", "typescript") and patterns is FUNCTION_PATTERNS:
            found = F.concat(found, _extract(code, METHOD_PATTERN))
        chain = F.when(language == name, found) if chain is None else chain.when(language == name, found)
    return F.coalesce(F.array_distinct(chain), _empty())


SYMBOL_FIELDS = ("added_functions", "removed_functions", "added_classes", "removed_classes")


def symbol_changes(patch: Column, filename: Column) -> Column:
    """STRUCT<language, four name sets>: names defined only in the new or only in the old version
    of the patched code, outside texts and comments. Both versions and their names are bound to one-element arrays, so each
    is computed once per row."""
    language = language_of(filename, SYMBOL_LANGUAGES)

    def stripped(code: Column) -> Column:
        chain = F.when(language == "python", code_only(code, "python")).when(language == "go", code_only(code, "go"))
        return chain.otherwise(code_only(code, "javascript"))

    versions = F.array(
        F.struct(language.alias("lang"), stripped(old_code(patch)).alias("old"), stripped(new_code(patch)).alias("new"))
    )

    def scan(v: Column) -> Column:
        return F.struct(
            v["lang"].alias("language"),
            _by_language(v["old"], v["lang"], FUNCTION_PATTERNS).alias("old_f"),
            _by_language(v["new"], v["lang"], FUNCTION_PATTERNS).alias("new_f"),
            _by_language(v["old"], v["lang"], CLASS_PATTERNS).alias("old_c"),
            _by_language(v["new"], v["lang"], CLASS_PATTERNS).alias("new_c"),
        )

    def compare(n: Column) -> Column:
        sides = (("new_f", "old_f"), ("old_f", "new_f"), ("new_c", "old_c"), ("old_c", "new_c"))
        sets = [F.array_except(n[a], n[b]).alias(out) for out, (a, b) in zip(SYMBOL_FIELDS, sides, strict=True)]
        return F.struct(n["language"].alias("language"), *sets)

    return F.get(F.transform(F.transform(versions, scan), compare), F.lit(0))


# Definition scan: keyword patterns per language; name in group 1.
SCAN_CLASS = {
    "python": r"^class[ \t]+(\w+)",
    "javascript": r"^(?:export[ \t]+)?(?:default[ \t]+)?class[ \t]+(\w+)",
    "typescript": r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(\w+)",
    "cpp": r"^class[ \t]+(\w+)",
    "c_sharp": r"^(?:(?:public|private|protected|internal|static|abstract|sealed|partial)[ \t]+)*class[ \t]+(\w+)",
    "rust": r"^(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(\w+)",
}
# Blocks whose functions are methods though they give no class name.
SCAN_OWNER = {"rust": r"^(?:unsafe[ \t]+)?impl\b"}
SCAN_FUNCTION = {
    "python": r"^def[ \t]+(\w+)",
    "javascript": r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]+(\w+)",
    "typescript": r"^(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]+(\w+)",
    "go": r"^func[ \t]+(\w+)",
    "cpp": r"^(?!return\b|else\b|if\b|for\b|while\b|switch\b|new\b|using\b)[A-Za-z_][\w:<>,*& \t]*[ \t*&](\w+)\([^;]*$",
    "rust": r"^(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+)?(?:unsafe[ \t]+)?fn[ \t]+(\w+)",
}
SCAN_ARROW = r"^(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[^=]*=[^=>][^;]*=>"


# What is no code, by language: texts and comments, also over several lines. The alternatives are tried at each place from
# left to right, so that a mark inside another one opens nothing; the loops are possessive and do not go back.
QUOTED = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
APOSTROPHES = QUOTED.replace('"', "'")
OVER_LINES = QUOTED.replace(r"\n", "")
TRIPLE = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
BACKQUOTES = OVER_LINES.replace('"', "`")
CHARACTER = r"'(?:\\[^\n']{1,9}|\\'|[^'\\\n])'"
SLASHES = r"//[^\n]*+|/\*[\s\S]*?\*/"
EXPRESSION = r"(?<=[=(,:!&|?\[][ \t]{0,4})/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\n\[])++/"
_SCRIPT = "|".join((EXPRESSION, SLASHES, QUOTED, APOSTROPHES, BACKQUOTES))
NO_CODE = {
    "python": "|".join((TRIPLE, TRIPLE.replace('"', "'"), QUOTED, APOSTROPHES, r"#[^\n]*+")),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": "|".join((SLASHES, QUOTED, CHARACTER, r"`[^`]*+`")),
    "cpp": "|".join((SLASHES, r'R"([^()\\\s]{0,16})\([\s\S]*?\)\1"', QUOTED, CHARACTER)),
    "c_sharp": "|".join((SLASHES, r'"""[\s\S]*?"""', r'(?:@\$?|\$@)"[^"]*+(?:""[^"]*+)*+"', QUOTED, CHARACTER)),
    "rust": "|".join((SLASHES, r'\bb?r(#*+)"[\s\S]*?"\1', OVER_LINES, CHARACTER)),
}


def code_only(code: Column, language: str) -> Column:
    """The code with each text and comment replaced by a blank, lines inside them included.

    A mark that is never closed hides nothing: a patch may show only its part. A patch that begins inside a text reads
    the mark that closes it as one that opens. Templates nested in a template's expression, and comments nested in
    comments, end at the first mark that closes."""
    return F.regexp_replace(code, NO_CODE[language], " ") if language in NO_CODE else code


def definitions(code: Column, language: str) -> Column:
    """STRUCT<classes, functions> of one language; functions inside a class are left out.

    Texts and comments are left out first. A fold over the lines keeps the open blocks: by indentation for python,
    by braces elsewhere.
    """
    lines = F.filter(F.split(code_only(code, language), "\n"), lambda x: x.rlike(r"\S"))
    fold = _fold_indent if language == "python" else _fold_braces
    if language not in SCAN_CLASS and language not in SCAN_FUNCTION:
        return F.struct(_empty().alias("classes"), _empty().alias("functions"))
    return fold(lines, language)


def _result(acc: Column) -> Column:
    return F.struct(acc["classes"].alias("classes"), acc["functions"].alias("functions"))


def _match(line: Column, pattern: str | None) -> Column:
    return F.lit("") if pattern is None else F.regexp_extract(line, pattern, 1)


def _append(names: Column, name: Column) -> Column:
    return F.when(name != "", F.array_append(names, name)).otherwise(names)


def _fold_indent(lines: Column, language: str) -> Column:
    start = F.struct(
        _empty().alias("classes"),
        _empty().alias("functions"),
        F.array().cast("array<struct<depth:int,is_class:boolean>>").alias("open"),
    )

    def step(acc: Column, line: Column) -> Column:
        depth = F.length(F.regexp_extract(line, r"^[ \t]*", 0))
        body = F.ltrim(line)
        ends_header = body.rlike(r"^[)\]}]")  # the last line of a header over several lines belongs to the block it opens
        still_open = F.filter(acc["open"], lambda b: (b["depth"] < depth) | (ends_header & (b["depth"] == depth)))
        in_class = F.coalesce(F.try_element_at(still_open, F.lit(-1))["is_class"], F.lit(False))
        cls, fn = _match(body, SCAN_CLASS[language]), _match(body, SCAN_FUNCTION[language])
        opens = ((cls != "") | (fn != "") | body.rlike(r":\s*$")) & ~ends_header
        block = F.struct(depth.alias("depth"), (cls != "").alias("is_class"))
        return F.struct(
            _append(acc["classes"], cls).alias("classes"),
            _append(acc["functions"], F.when(in_class, F.lit("")).otherwise(fn)).alias("functions"),
            F.when(opens, F.array_append(still_open, block)).otherwise(still_open).alias("open"),
        )

    return F.aggregate(lines, start, step, _result)


def _fold_braces(lines: Column, language: str) -> Column:
    start = F.struct(
        _empty().alias("classes"),
        _empty().alias("functions"),
        F.lit(0).alias("depth"),
        F.lit(-1).alias("class_depth"),
    )

    def step(acc: Column, line: Column) -> Column:
        body = F.ltrim(line)
        cls = _match(body, SCAN_CLASS.get(language))
        fn = _match(body, SCAN_FUNCTION.get(language))
        if language in ("javascript", "typescript"):
            fn = F.when(fn == "", _match(body, SCAN_ARROW)).otherwise(fn)
        owner = (cls != "") | (body.rlike(SCAN_OWNER[language]) if language in SCAN_OWNER else F.lit(False))
        owner = owner & (line.contains("{") | ~line.rlike(r";\s*$"))  # a declaration without a body opens no block
        inside = acc["class_depth"] >= 0
        change = F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))
        depth = acc["depth"] + change
        opened = F.when(inside, acc["class_depth"]).when(owner, acc["depth"]).otherwise(F.lit(-1))
        closed = (opened >= 0) & (depth <= opened) & line.contains("}")
        return F.struct(
            _append(acc["classes"], cls).alias("classes"),
            _append(acc["functions"], F.when(inside | (cls != ""), F.lit("")).otherwise(fn)).alias("functions"),
            depth.alias("depth"),
            F.when(closed, F.lit(-1)).otherwise(opened).alias("class_depth"),
        )

    return F.aggregate(lines, start, step, _result)
