"""Line splitting and per-line cleaning.

Functions that read their input several times come as ``with_...`` steps on a DataFrame: the
optimizer does not merge such steps, so a text is split or cleaned once.

Three splitters exist and differ only in how they treat a carriage return:
``rule_lines`` keeps it, ``check_lines`` drops one before each line feed, and
``with_clean_text`` drops all of them. None adds an empty line
for a final line feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"
DEBUG_WORD = r"(?i)\b(debug|trace)\b"
EXIT_LINE = r"(?i)^(exit[: ]|process exited|command failed|error code)"
TAG = "gist"


def trimmed(parts: Column) -> Column:
    """Split parts without the empty one after a final line feed."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rule_lines(text: Column) -> Column:
    return trimmed(F.split(F.coalesce(text, F.lit("")), "\n", -1))


def check_lines(text: Column) -> Column:
    return rule_lines(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def with_lines(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Split in two steps: the parts are read several times, and must be made once."""
    return df.withColumn(name, F.split(F.coalesce(text, F.lit("")), "\n", -1)).withColumn(name, trimmed(F.col(name)))


def with_check_lines(df: DataFrame, name: str, text: Column) -> DataFrame:
    return with_lines(df, name, F.replace(text, F.lit("\r\n"), F.lit("\n")))


def strip_cr(text: Column) -> Column:
    """Trim all carriage returns at the end of each line."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r+(?=\n|\z)", "")).otherwise(text)


def strip_ansi(text: Column) -> Column:
    # Nearly no line has an escape, and looking for one costs far less than the pattern.
    return F.when(text.contains("\x1b"), F.regexp_replace(text, ANSI, "")).otherwise(text)


def with_clean_text(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Carriage returns first, then colour codes; both work on the whole text at once
    because neither pattern can cross a line feed."""
    return df.withColumn(name, F.coalesce(text, F.lit(""))).withColumn(name, strip_cr(F.col(name))).withColumn(
        name, strip_ansi(F.col(name)))


def is_placeholder_text(text: Column, tag: str = TAG) -> Column:
    head = F.regexp_replace(text, r"(?U)^\s+", "")
    marks = ("[... ", f"[{tag}:", "[REDACTED:", f"--- [{tag}:")
    hit = head.startswith(marks[0])
    for mark in marks[1:]:
        hit = hit | head.startswith(mark)
    return hit


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def template_placeholder(placeholder: Column | str, count: Column) -> Column:
    placeholder = F.lit(placeholder) if isinstance(placeholder, str) else placeholder
    return F.replace(placeholder, F.lit("{count}"), count.cast("string"))


def line_bytes(text: Column) -> Column:
    """Bytes a line takes in the output, its line feed included."""
    return (F.octet_length(text) + 1).cast("bigint")
