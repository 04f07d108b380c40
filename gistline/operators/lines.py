"""Texts to ordered lines and back.

Arrays are exploded with the outer form and a filter on the result: for the plain form the
optimizer adds a filter on the array, pushes it below the steps that made the array, and so
makes it twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions import text as T


def explode_lines(sessions: DataFrame, check: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line, for rules or, with ``check``, for checks. No shuffle: a text is
    split where its row is."""
    step = T.with_check_lines if check else T.with_lines
    split = step(sessions.select("session_id", *keep, "text"), "_l", F.col("text"))
    return split.select("session_id", *keep, F.posexplode_outer("_l")).where("pos is not null").select(
        "session_id", *keep,
        F.col("pos").cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("sub_no"),
        F.col("col").alias("text"), F.lit(False).alias("is_placeholder"),
    )


def clean_arrays(sessions: DataFrame, keep: tuple[str, ...] = (), name: str = "clean") -> DataFrame:
    """Each text as an array of cleaned lines with their line numbers: carriage returns off,
    then colour codes, then adjacent repeats.

    A line's neighbour is read from the array it was split into, so even the repeat check
    needs no shuffle and no sort.
    """
    cleaned = T.with_clean_text(sessions.select("session_id", *keep, "text"), "text", F.col("text"))
    split = T.with_lines(cleaned, "_l", F.col("text"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))))
    # zip_with pads the shorter side; for an empty text that is one pair without a line.
    marked = F.zip_with("_l", before, lambda t, b: F.when(
        t.isNotNull(), F.struct(t.alias("t"), (b.isNull() | (t != b)).alias("fresh"))))
    numbered = F.transform(marked, lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), x["fresh"].alias("fresh")))
    return split.select("session_id", *keep, F.filter(numbered, lambda x: x["fresh"]).alias(name))


def clean_lines(arrays: DataFrame, keep: tuple[str, ...] = (), name: str = "clean") -> DataFrame:
    return arrays.select("session_id", *keep, F.explode_outer(name).alias("_x")).where("_x is not null").select(
        "session_id", *keep,
        F.col("_x.i").cast("bigint").alias("line_no"), F.lit(0).cast("bigint").alias("sub_no"),
        F.col("_x.t").alias("text"), F.lit(False).alias("is_placeholder"),
    )


def clean_output(name: str = "clean") -> Column:
    """The cleaned text, a line feed after each line."""
    return F.array_join(F.transform(F.col(name), lambda x: F.concat(x["t"], F.lit("\n"))), "")


def generic_clean(sessions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pass every text gets, as lines."""
    return clean_lines(clean_arrays(sessions, keep), keep)


def assemble_output(lines: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Ordered lines to one text, a line feed after each.

    The text is one value, so a session assembled here fits a row by definition; longer
    results stay a line table. With ``sessions``, those without lines get an empty text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "sub_no", "text")))
    texts = lines.groupBy("session_id").agg(
        F.array_join(F.transform(ordered, lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("text"))
    if sessions is None:
        return texts
    return sessions.select("session_id").join(texts, "session_id", "left").select(
        "session_id", F.coalesce("text", F.lit("")).alias("text"))


def output_bytes(lines: DataFrame, name: str = "compressed_bytes") -> DataFrame:
    return lines.groupBy("session_id").agg(F.sum(T.line_bytes(F.col("text"))).alias(name))


def active(when: Column | None) -> Column:
    return F.lit(True) if when is None else F.coalesce(when, F.lit(False))


def verbatim(when: Column | None = None) -> Column:
    """Lines a rule may test: placeholders never are."""
    plain = ~F.col("is_placeholder")
    return plain if when is None else plain & active(when)
