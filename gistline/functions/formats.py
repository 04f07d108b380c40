"""Format class of a text, in fixed priority. Every test is local to the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions.jsontext import json_valid
from gistline.functions.text import is_blank, with_check_lines

# Fixed values.
STACK_TRACE = (
    r"(?dUm)(^\s*Traceback \(most recent call last\):|^\s*at [\w.]+\(|\bthread 'main' panicked at)"
)
LOG = (
    r"(?dUm)^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\[\d{2}:\d{2}:\d{2}\]|"
    r"\w{3} \d{1,2} \d{2}:\d{2}:\d{2}|(?i)^(debug|info|warn|error|fatal|trace)[: ])"
)
HUNK = r"(?dm)^@@ "
DIFF_HEADER = r"(?dm)^(diff --git|--- |\+\+\+ )"


def is_json(text: Column) -> Column:
    head = F.regexp_replace(text, r"(?U)^\s+", "")
    return (head.startswith("{") | head.startswith("[")) & json_valid(head)


def is_ndjson(lines: Column, filled: Column) -> Column:
    """First five lines blank or valid JSON, and at least two non-blank lines in all."""
    return F.forall(F.slice(lines, 1, 5), lambda x: is_blank(x) | json_valid(x)) & (F.size(filled) >= 2)


def is_diff(text: Column) -> Column:
    return text.rlike(HUNK) & text.rlike(DIFF_HEADER)


def is_stack_trace(text: Column) -> Column:
    return text.rlike(STACK_TRACE)


def is_log(text: Column) -> Column:
    return text.rlike(LOG)


def is_tabular(filled: Column, words: Column) -> Column:
    """At least three non-blank lines; the first five share one word count of two or more."""
    return (F.size(filled) >= 3) & (F.array_min(words) >= 2) & (F.array_min(words) == F.array_max(words))


def with_line_facts(df: DataFrame, text: str) -> DataFrame:
    """``_lines``, the non-blank ones, and the word counts of the first five of those."""
    df = with_check_lines(df, "_lines", F.col(text))
    df = df.withColumn("_filled", F.filter("_lines", lambda x: ~is_blank(x)))
    return df.withColumn("_words", F.transform(F.slice("_filled", 1, 5), lambda x: F.size(F.filter(
        F.split(x, r"(?U)\s+"), lambda w: w != ""))))


def with_format(df: DataFrame, text: str = "text", name: str = "format") -> DataFrame:
    """The class of each text; null for a null text."""
    t = F.col(text)
    out = (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(is_json(t), "json")
        .when(is_ndjson(F.col("_lines"), F.col("_filled")), "ndjson")
        .when(is_diff(t), "diff")
        .when(is_stack_trace(t), "stack_trace")
        .when(is_tabular(F.col("_filled"), F.col("_words")), "tabular")
        .when(is_log(t), "log")
        .otherwise("plain")
    )
    return with_line_facts(df, text).withColumn(name, out).drop("_lines", "_filled", "_words")
