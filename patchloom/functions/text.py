"""Text measures and pattern features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words, as the inside of a pattern class (\p{Z}
# holds every Unicode separator) and as plain text. Listing single characters instead of
# ranges keeps the class a bit set, which is many times faster to scan with.
SPACES = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}\p{Z}"
SPACE_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Pattern of an issue or task reference.
ISSUE_LINK = (
    r"\b(?:closes|fixes|resolves|related to|issue links?|tickets?)"
    r"(?:[:\s]+(?:#\d+|[A-Za-z]{2,}-\d+|[A-Za-z]+-\d+))"
)
# Pattern of a template heading.
TEMPLATE_HEADING = (
    r"^(?:#+\s*|\s*|:)?(Description|Summary|Motivation|Context|Testing Steps"
    r"|How to Test|Validation|Checklist|To-Do|Screenshots)\b"
)
# Patterns of a checklist item and of a fenced code block.
CHECKLIST_ITEM = r"^[\s*]*[-*]?\s*\[[xX\s]\]"
CODE_FENCE = r"```(?:\w*)\s*([\s\S]*?)```"


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.trim(text, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of words between white space; null stays null."""
    return F.regexp_count(text, F.lit(rf"[^{SPACES}]+")).cast("long")


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.length(text)


def has_text(text: Column) -> Column:
    """True unless null or white space only."""
    return F.coalesce(text.rlike(rf"[^{SPACES}]"), F.lit(False))


def description(title: Column, body: Column) -> Column:
    """Title and body with a blank between; null when either is null."""
    return F.concat(title, F.lit(" "), body)


def issue_links(text: Column) -> Column:
    """All issue references, in text order."""
    return F.regexp_extract_all(text, F.lit("(?iU)" + ISSUE_LINK), F.lit(0))


def has_issue_link(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iU)" + ISSUE_LINK), F.lit(False))


def template_headings(text: Column) -> Column:
    """Distinct headings as written: 'Summary' and 'SUMMARY' are two."""
    found = F.regexp_extract_all(text, F.lit("(?imdU)" + TEMPLATE_HEADING), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def checklist_items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?mdU)" + CHECKLIST_ITEM), F.lit(0))


def has_checklist(text: Column, fixed: bool = False) -> Column:
    """By default every non-null text counts, which is the published behaviour;
    ``fixed=True`` asks for at least one item."""
    if not fixed:
        return text.isNotNull()
    return F.coalesce(F.size(checklist_items(text)) > 0, F.lit(False))


def code_snippets(text: Column) -> Column:
    """Trimmed contents of fenced blocks; an empty array for null text."""
    found = F.regexp_extract_all(text, F.lit("(?sU)" + CODE_FENCE), F.lit(1))
    return F.coalesce(F.transform(found, strip), F.array().cast("array<string>"))


def has_code(text: Column) -> Column:
    return F.size(code_snippets(text)) > 0


def code_ratio(text: Column, words: Column) -> Column:
    """Code blocks per body word."""
    return F.try_divide(F.size(code_snippets(text)).cast("double"), words)


def render(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` placeholders from columns; inserted text is never re-read.

    A null column renders as the empty string.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.index("{%s}" % n), n) for n in columns if "{%s}" % n in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, name = min(hits)
        pieces += [F.lit(rest[:at]), F.coalesce(columns[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def word_overlap(candidate: Column, reference: Column) -> Column:
    """Struct of precision, recall and F1 of the distinct words; null fields for a null text."""
    said, true = F.array_distinct(words(candidate)), F.array_distinct(words(reference))
    shared, c, r = F.size(F.array_intersect(said, true)).cast("double"), F.size(said), F.size(true)
    known = candidate.isNotNull() & reference.isNotNull()

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(known, F.coalesce(F.try_divide(top, bottom), F.lit(0.0)))

    return F.struct(
        ratio(shared, c).alias("precision"), ratio(shared, r).alias("recall"), ratio(2 * shared, c + r).alias("f1")
    )


def hashed_words(text: Column, size: int) -> Column:
    """ARRAY<FLOAT>: how many words fall in each of ``size`` slots of their hash; null for blank text."""
    slots = F.transform(
        words(text),
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int"),
    )
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float")
    )
    return F.when(F.size(slots) > 0, counts)


def key_sentence(text: Column) -> Column:
    """The sentence of the whole text with the most distinct words, the first of equal ones; null for blank text."""
    parts = F.transform(
        F.split(text, r"[.!?\n]+"),
        lambda s, i: F.struct(F.size(F.array_distinct(words(s))).alias("n"), (-i).alias("at"), F.trim(s).alias("s")),
    )
    best = F.array_max(parts)
    return F.when(best["n"] > 0, best["s"])


def message_rules(message: Column, patch: Column) -> tuple[Column, Column]:
    """Rule scores in 0..5: half the words of the message, and its distinct words that the patch has too."""
    known = has_text(message) & has_text(patch)
    said = words(message)
    shared = F.array_intersect(F.array_distinct(said), F.array_distinct(words(patch)))
    return (
        F.when(known, F.least(F.lit(5), F.floor(F.size(said) / 2).cast("int"))).alias("what_score"),
        F.when(known, F.least(F.lit(5), F.size(shared))).alias("why_score"),
    )
