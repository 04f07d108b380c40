"""Format class of sessions that come as line tables, in the same priority as for texts.

Every class follows from flags of lines, which partial sums can hold, and JSON from tokens, which are
folded in order piece by piece. No session is put together, so one of any length has the class of a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions import formats
from gistline.functions.jsontext import MAX_DEPTH, depths, folded, json_valid, tokens
from gistline.functions.text import is_blank
from gistline.operators.scan import WINDOW, fold_ordered, running
from gistline.session import fits_broadcast, stored


def json_documents(lines: DataFrame, scalars: bool = False) -> DataFrame:
    """session_id of the sessions (session_id, line_no, sub_no, text) whose lines are one JSON document: an object or
    array or, with ``scalars``, any value."""
    form = lines.select("session_id", "line_no", "sub_no", tokens(F.coalesce("text", F.lit(""))).alias("form"))
    pieces = form.select("session_id", "line_no", "sub_no", folded(F.col("form")).alias("piece"), depths(F.col("form")).alias("deep"))

    def merge(pieces: Column) -> dict[str, Column]:
        deep = F.aggregate(pieces["deep"], F.struct(F.lit(0).alias("net"), F.lit(0).alias("top")), lambda a, b: F.struct(
            (a["net"] + b["net"]).alias("net"), F.greatest(a["top"], a["net"] + b["top"]).alias("top")))
        return {"piece": folded(F.array_join(pieces["piece"], "")), "deep": deep}

    whole = fold_ordered(pieces, ["piece", "deep"], merge)
    return whole.where(F.col("piece").isin(*("xsv" if scalars else "x")) & (F.col("deep.top") <= MAX_DEPTH)).select("session_id")


def detect_format_lines(lines: DataFrame, order=WINDOW) -> DataFrame:
    """One row per session: session_id, format."""
    text = F.col("text")
    lines = lines.select("session_id", "line_no", "sub_no", "text", (~is_blank(text)).alias("__full"))
    df = order.scan(lines, running("__rn", F.lit(1).cast("bigint")), running("__nth", F.col("__full").cast("bigint")))
    full = F.col("__full")
    early = F.when(F.col("__rn") <= 5, ~full | F.coalesce(json_valid(text), F.lit(False)))
    words = F.when(full & (F.col("__nth") <= 5), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))
    start = F.when(full & (F.col("__nth") == 1), F.regexp_extract(text, r"(?U)^\s*([{\[])", 1) != "")
    facts = df.groupBy("session_id").agg(
        F.bool_and(early).alias("early"), F.count_if(full).alias("full"),
        F.bool_or(text.startswith("@@ ")).alias("hunk"), F.bool_or(text.rlike(formats.DIFF_HEADER)).alias("header"),
        F.bool_or(text.rlike(formats.STACK_TRACE)).alias("trace"), F.bool_or(text.rlike(formats.LOG)).alias("log"),
        F.min(words).alias("fewest"), F.max(words).alias("most"), F.max(start).alias("start"))
    facts = stored(facts)
    maybe = facts.where("start").select(F.col("session_id").alias("__id"))
    hint = F.broadcast(maybe) if fits_broadcast(maybe) else maybe
    # White space of any kind goes before a document, of its own kinds inside it.
    lead = F.when(F.col("__nth") <= 1, F.regexp_replace(text, r"(?U)^\s+", "")).otherwise(text)
    inside = df.join(hint, F.col("session_id").eqNullSafe(F.col("__id")), "left_semi").withColumn("text", lead)
    documents = json_documents(inside).select(F.col("session_id").alias("__id"), F.lit(True).alias("document"))
    joined = facts.join(documents, F.col("session_id").eqNullSafe(F.col("__id")), "left")
    out = (
        F.when(F.col("document"), "json")
        .when(F.col("early") & (F.col("full") >= 2), "ndjson")
        .when(F.col("hunk") & F.col("header"), "diff")
        .when(F.col("trace"), "stack_trace")
        .when((F.col("full") >= 3) & (F.col("fewest") >= 2) & (F.col("fewest") == F.col("most")), "tabular")
        .when(F.col("log"), "log")
        .otherwise("plain"))
    return joined.select("session_id", out.alias("format"))
