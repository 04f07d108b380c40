"""Rules that look at one line only. They need no shuffle and run before any that do.

``when`` restricts a rule to some sessions, for plans that hold many rule sets at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions import text as T
from gistline.functions.jsontext import ndjson_keeps
from gistline.functions.regex import matches
from gistline.operators.lines import active, verbatim


def keep_lines(lines: DataFrame, pattern: str | Column, when: Column | None = None) -> DataFrame:
    return lines.where(~verbatim(when) | matches(F.col("text"), pattern))


def drop_lines(lines: DataFrame, pattern: str | Column, when: Column | None = None) -> DataFrame:
    return lines.where(~(verbatim(when) & matches(F.col("text"), pattern)))


def strip_ansi(lines: DataFrame, when: Column | None = None) -> DataFrame:
    return lines.withColumn(
        "text", F.when(verbatim(when), T.strip_ansi(F.col("text"))).otherwise(F.col("text")))


def strip_cr(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", T.strip_cr(F.col("text")))


def ndjson_filter(lines: DataFrame, field: str | Column, keep_values: list[str] | Column,
                  when: Column | None = None) -> DataFrame:
    kept = ndjson_keeps(F.col("text"), field, keep_values)
    return lines.where(~verbatim(when) | kept)


def drop_debug_lines(lines: DataFrame, format_column: str = "format") -> DataFrame:
    """Only in texts of class log, and anywhere in the line."""
    debug = matches(F.col("text"), T.DEBUG_WORD)
    return lines.where(~((F.col(format_column) == "log") & debug))
