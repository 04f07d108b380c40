"""Rules that depend on the order of lines.

Each takes the scan plan to use (``operators.scan``) and, where a plan holds many rule sets,
the condition under which a session uses the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions.regex import matches
from gistline.functions.text import TAG, line_bytes, template_placeholder
from gistline.operators.lines import active, verbatim
from gistline.operators.scan import WINDOW, latest, prev, running, total, upcoming


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def dedup_adjacent(lines: DataFrame, order=WINDOW, when: Column | None = None) -> DataFrame:
    """Drop a line equal to the one before. A dropped line equals the last kept one, so
    comparing with the direct neighbour is enough; placeholders take part."""
    df = order.scan(lines, prev("__before", F.col("text")))
    fresh = F.col("__before").isNull() | (F.col("text") != F.col("__before"))
    return _drop_helpers(df.where(~active(when) | fresh))


def collapse_repeated(lines: DataFrame, pattern, placeholder, min_run=3, order=WINDOW,
                      when: Column | None = None) -> DataFrame:
    """Replace each run of at least ``min_run`` hits by one placeholder at its first line.

    A run ends at the next line that is no hit, so its length is the distance between the
    last and the next such line; no group by run is needed, however long the run is.
    """
    df = lines.withColumn("__hit", verbatim(when) & matches(F.col("text"), pattern))
    df = order.scan(df, running("__rn", F.lit(1).cast("bigint")))
    miss = F.when(~F.col("__hit"), F.col("__rn"))
    df = order.scan(df, latest("__lo", miss), upcoming("__hi", miss), total("__n", "max", F.col("__rn")))
    low = F.coalesce("__lo", F.lit(0))
    length = F.coalesce(F.col("__hi"), F.col("__n") + 1) - low - 1
    long = F.col("__hit") & (length >= _value(min_run))
    df = df.withColumns({"__long": long, "__len": length, "__first": F.col("__rn") == low + 1})
    df = df.where(~F.col("__long") | F.col("__first"))
    text = F.when(F.col("__long"), template_placeholder(placeholder, F.col("__len")))
    df = df.withColumns({
        "text": text.otherwise(F.col("text")),
        "is_placeholder": F.col("is_placeholder") | F.col("__long"),
    })
    return _drop_helpers(df)


def _with_extra(df: DataFrame, extra: Column, extra_text: Column, keep_line: Column) -> DataFrame:
    """Emit a placeholder before a line, a line, both or none. Positions stay in order:
    the placeholder takes the even sub-position and the line the odd one."""
    empty = F.array().cast("array<struct<k:int,text:string,is_placeholder:boolean>>")
    made = F.when(extra, F.array(F.struct(
        F.lit(0).alias("k"), extra_text.alias("text"), F.lit(True).alias("is_placeholder")))).otherwise(empty)
    own = F.when(keep_line, F.array(F.struct(
        F.lit(1).alias("k"), F.col("text").alias("text"),
        F.col("is_placeholder").alias("is_placeholder")))).otherwise(empty)
    names = [c for c in df.columns if not c.startswith("__")]
    out = df.select(*[c for c in names if c not in ("text", "is_placeholder")],
                    F.explode(F.concat(made, own)).alias("__e"))
    out = out.withColumns({
        "sub_no": F.col("sub_no") * 2 + F.col("__e.k"),
        "text": F.col("__e.text"), "is_placeholder": F.col("__e.is_placeholder"),
    })
    return out.select(*names)


def collapse_between(lines: DataFrame, begin, end, placeholder, order=WINDOW,
                     when: Column | None = None) -> DataFrame:
    """Drop what lies between two fences and say how much, also when it was nothing.

    Whether a line lies inside follows from the last line that matched only one fence, and
    from how many lines matched both since (each of those flips the state).
    """
    testable = verbatim(when)
    df = lines.withColumns({
        "__b": testable & matches(F.col("text"), begin), "__e": testable & matches(F.col("text"), end)})
    flips = (F.col("__b") & F.col("__e")).cast("bigint")
    df = order.scan(df, running("__flips", flips), total("__last", "max", F.struct("line_no", "sub_no")))
    marker = F.when(F.col("__b") != F.col("__e"),
                    F.struct(F.col("__b").alias("inside"), F.col("__flips").alias("at")))
    df = order.scan(df, latest("__mark", marker))
    odd = (F.col("__flips") - F.coalesce(F.col("__mark.at"), F.lit(0))) % 2 == 1
    df = df.withColumn("__after", F.coalesce(F.col("__mark.inside"), F.lit(False)) != odd)
    df = order.scan(df, prev("__was", F.col("__after")))
    inside = F.coalesce(F.col("__was"), F.lit(False))
    df = df.withColumns({"__inner": inside & ~F.col("__e"), "__close": inside & F.col("__e"),
                         "__open": ~inside & F.col("__b")})
    df = order.scan(df, running("__seen", F.col("__inner").cast("bigint")))
    df = order.scan(df, latest("__base", F.when(F.col("__open"), F.col("__seen"))))
    count = F.col("__seen") - F.coalesce("__base", F.lit(0))
    at_end = F.col("__inner") & (F.struct("line_no", "sub_no") == F.col("__last"))
    return _with_extra(df, F.col("__close") | at_end, template_placeholder(placeholder, count), ~F.col("__inner"))


def head(lines: DataFrame, n, order=WINDOW, when: Column | None = None) -> DataFrame:
    df = order.scan(lines, running("__rn", F.lit(1).cast("bigint")))
    return _drop_helpers(df.where(~active(when) | (F.col("__rn") <= _value(n))))


def tail(lines: DataFrame, n, order=WINDOW, when: Column | None = None) -> DataFrame:
    one = F.lit(1).cast("bigint")
    df = order.scan(lines, running("__rn", one), total("__n", "sum", one))
    return _drop_helpers(df.where(~active(when) | (F.col("__rn") > F.col("__n") - _value(n))))


def _anchored(lines: DataFrame, pattern, order, when) -> DataFrame:
    df = lines.withColumn("__hit", verbatim(when) & matches(F.col("text"), pattern))
    df = order.scan(df, running("__rn", F.lit(1).cast("bigint")))
    return order.scan(df, total("__anchor", "min", F.when(F.col("__hit"), F.col("__rn"))))


def head_after(lines: DataFrame, n, pattern, order=WINDOW, when: Column | None = None) -> DataFrame:
    """Everything up to the first hit, and ``n`` lines after it; all lines without a hit."""
    df = _anchored(lines, pattern, order, when)
    keep = F.col("__anchor").isNull() | (F.col("__rn") <= F.col("__anchor") + _value(n))
    return _drop_helpers(df.where(~active(when) | keep))


def tail_before(lines: DataFrame, n, pattern, order=WINDOW, when: Column | None = None) -> DataFrame:
    """From ``n`` lines before the first hit to the end; all lines without a hit."""
    df = _anchored(lines, pattern, order, when)
    keep = F.col("__anchor").isNull() | (F.col("__rn") >= F.col("__anchor") - _value(n))
    return _drop_helpers(df.where(~active(when) | keep))


def state_machine(lines: DataFrame, states: list[dict] | Column, order=WINDOW,
                  when: Column | None = None) -> DataFrame:
    """Sections: a line that matches a state's ``enter`` starts that state and is judged by
    it. In a state, ``drop`` wins over ``keep`` and an empty ``keep`` keeps; before any
    state all lines stay."""
    text = F.col("text")
    if isinstance(states, Column):
        hits = F.filter(F.transform(states, lambda s, i: F.when(matches(text, s["enter"]), i)),
                        lambda x: x.isNotNull())
        entered = F.when(verbatim(when), F.get(hits, F.lit(0)))
    else:
        entered = F.lit(None).cast("int")
        for i, s in reversed(list(enumerate(states))):
            entered = F.when(matches(text, s["enter"]), F.lit(i)).otherwise(entered)
        entered = F.when(verbatim(when), entered)
    df = order.scan(lines, latest("__state", entered))
    state = F.col("__state")
    if isinstance(states, Column):
        s = F.get(states, state)
        keeps, drops = F.coalesce(s["keep"], F.array()), F.coalesce(s["drop"], F.array())
        keep = ~F.exists(drops, lambda p: matches(text, p)) & (
            (F.size(keeps) == 0) | F.exists(keeps, lambda p: matches(text, p)))
    else:
        keep = F.lit(True)
        for i, s in enumerate(states):
            wanted = F.lit(True) if not s.get("keep") else F.lit(False)
            for p in s.get("keep") or ():
                wanted = wanted | matches(text, p)
            for p in s.get("drop") or ():
                wanted = wanted & ~matches(text, p)
            keep = F.when(state == i, wanted).otherwise(keep)
    keep = state.isNull() | keep
    return _drop_helpers(df.where(~verbatim(when) | keep))


def truncate_to(lines: DataFrame, size, order=WINDOW, when: Column | None = None) -> DataFrame:
    """Longest prefix within ``size`` bytes, then one placeholder where it was cut."""
    width = line_bytes(F.col("text"))
    df = order.scan(lines, running("__used", width))
    over = active(when) & (F.col("__used") > _value(size))
    cut = over & (F.col("__used") - width <= _value(size))
    df = df.withColumns({"__over": over, "__cut": cut}).where(~F.col("__over") | F.col("__cut"))
    note = F.concat(F.lit("[... truncated to "), _value(size).cast("string"), F.lit(" bytes ...]"))
    df = df.withColumns({
        "text": F.when(F.col("__cut"), note).otherwise(F.col("text")),
        "is_placeholder": F.col("is_placeholder") | F.col("__cut"),
    })
    return _drop_helpers(df)


def head_tail_envelope(lines: DataFrame, head_n: int, tail_n: int, order=WINDOW, tag: str = TAG) -> DataFrame:
    """First and last lines with a marker between them, also when nothing lies between."""
    if head_n == 0 and tail_n == 0:
        return lines
    one = F.lit(1).cast("bigint")
    df = order.scan(lines, running("__rn", one), total("__n", "sum", one))
    rn, n = F.col("__rn"), F.col("__n")
    skip = F.greatest(F.lit(head_n).cast("bigint"), n - tail_n)
    in_tail = rn > skip if tail_n else F.lit(False)
    kept = (rn <= head_n) | in_tail
    df = df.where(kept)
    shown = F.least(n - head_n, F.lit(tail_n).cast("bigint"))
    note = F.concat(F.lit(f"--- [{tag}: middle elided, showing first {head_n} and last "),
                    shown.cast("string"), F.lit(" lines] ---"))
    first_of_tail = in_tail & (rn == skip + 1) if head_n else F.lit(False)
    return _with_extra(df, first_of_tail, note, F.lit(True))


def order_rows(lines: DataFrame, order=WINDOW) -> DataFrame:
    """Lines numbered 1, 2, ... in their session as ``__rn``."""
    return order.scan(lines, running("__rn", F.lit(1).cast("bigint")))
