"""Text expressions of the metadata preparation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "\\t\\n\\f\\r "


def clean_strict(text: Column) -> Column:
    """Without anything but ASCII letters, digits, blanks and the apostrophe."""
    return F.regexp_replace(text, f"[^a-zA-Z0-9{BLANK}']", "")


def clean_punctuated(text: Column) -> Column:
    """As ``clean_strict``, but with hyphen, full stop, comma, exclamation and question marks."""
    return F.regexp_replace(text, f"[^a-zA-Z0-9{BLANK}'\\-.,!?]", "")


def without_prefix(name: Column, prefix: str) -> Column:
    """Without ``prefix`` and the mark after it, if it stands at the front."""
    return F.regexp_replace(name, f"^{prefix}[-#]?", "")


def shortened(text: Column, most: int = 20, keep: int = 16) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def path_part(path: Column, from_end: int) -> Column:
    """A part of a path without its query, counted from the end; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "^[a-z]+://", "")
    return F.try_element_at(F.split(bare, "/"), F.lit(-from_end))


def stem(path: Column) -> Column:
    return F.regexp_replace(path_part(path, 1), "\\.[^.]*$", "")


def to_float(x: Column) -> Column:
    """As a number's text if it parses, else unchanged."""
    return F.coalesce(x.try_cast("double").cast("string"), x)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes", "on")


def relative_to(path: Column, base: str) -> Column:
    """Relative to ``base`` if it lies there; null and empty pass through."""
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def letters(text: Column) -> Column:
    """The characters of each word, an array of arrays."""
    return F.transform(F.filter(F.split(text, "\\s+"), lambda w: w != ""), lambda w: F.filter(F.split(w, ""), lambda c: c != ""))


def occurrences(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / F.lit(len(mark))


def tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), "\\s+"), lambda x: x != "")
