"""Paths, URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language, as the churn analysis uses it.
CHURN_LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".pyw": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
}

# The wider map used when old and new code are compared.
SYMBOL_LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".pyw": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
}

# Leading dots of the last segment never start an extension.
EXTENSION = r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$"


def recode(value: Column, mapping: dict) -> Column:
    """Dictionary lookup; null and unknown keys give null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def segment_from_end(path: Column, position: int) -> Column:
    """The ``position``-th path segment counted from the end, null when too short."""
    return F.try_element_at(F.split(path, "/"), F.lit(-position))


def module_l1(path: Column) -> Column:
    """The folder that holds the file."""
    return segment_from_end(path, 2)


def module_l2(path: Column) -> Column:
    """The folder above the one that holds the file."""
    return segment_from_end(path, 3)


def repo_full_name(url: Column) -> Column:
    """``owner/repo`` from a repository URL."""
    return F.substring_index(url, "/", -2)


def repo_short_name(url: Column) -> Column:
    """``repo`` from a repository URL."""
    return F.substring_index(url, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' when there is none."""
    return F.regexp_extract(F.lower(path), EXTENSION, 1)


def language_of(path: Column, mapping: dict | None = None) -> Column:
    """Programming language by file extension, null when not in the map."""
    return recode(extension(path), mapping or CHURN_LANGUAGES)
