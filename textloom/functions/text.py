"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A word or number of a script with cases, or one character of another script. The same in Spark's and in SQL's patterns.
WORD = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{M}\p{N}]+|\p{Lo}"


def tokens(text: Column) -> Column:
    """Lower-case words and numbers; characters of scripts without cases one by one. Null gives null, a text without any an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def map_lines(text: Column, f) -> Column:
    """The text with every line replaced by f(line)."""
    return join_lines(F.transform(F.split(text, "\n"), f))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4)


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the phrases."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))
