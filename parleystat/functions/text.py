"""Text expressions with Python's Unicode idea of whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# `(?U)\s` covers Unicode White_Space; str.split() also breaks at the four separators 0x1c-0x1f.
SPACE = r"[\s\x1c-\x1f]"


def count_tokens(text: Column) -> Column:
    """Number of whitespace-separated tokens; a missing text has none."""
    words = F.array_remove(F.split(text, f"(?U){SPACE}+"), "")
    return F.when(text.isNull(), 0).otherwise(F.size(words)).cast("long")


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace (Spark's own trim drops spaces only)."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def non_empty(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def is_present(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def prefix(text: Column, chars: int) -> Column:
    """First `chars` code points."""
    return F.substring(text, 1, chars)
