"""Ordered scans inside a session, for sessions of any size.

Line rules need a few ordered facts about a line: the value before it, a running sum, the
last or next known value, a total. ``WindowScan`` reads them off one window per session.
That is the cheapest plan, but it puts a session into one task.

``BlockScan`` gives the same facts for a session that is too long for one task. Lines are
cut into even ranges by (session, order), whatever the values of the order column are; each
range is scanned on its own, and one summary row per session and range carries the state over
from the ranges before it. A task holds one range, or the summaries of one session, never all
lines of one session. A null key is a key like any other.

``run_ordered`` measures the sessions and picks the plan; both give the same rows.

``fold_ordered`` reduces each session to one row by a merge of neighbouring pieces, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistline.session import checkpoint, fits_broadcast, stored

MAX_TASK_LINES = 2_000_000
MAX_TASK_BYTES = 1 << 30
ORDER = ("line_no", "sub_no")


@dataclass(frozen=True)
class Fact:
    name: str
    kind: str
    expr: Column


def prev(name: str, expr: Column) -> Fact:
    """Value on the line before."""
    return Fact(name, "prev", expr)


def running(name: str, expr: Column) -> Fact:
    """Sum from the first line to this one."""
    return Fact(name, "running", expr)


def latest(name: str, expr: Column) -> Fact:
    """Last non-null value up to this line."""
    return Fact(name, "latest", expr)


def upcoming(name: str, expr: Column) -> Fact:
    """First non-null value from this line on."""
    return Fact(name, "upcoming", expr)


def total(name: str, aggregate: str, expr: Column) -> Fact:
    """Sum, min or max over the whole session."""
    return Fact(name, aggregate, expr)


TOTALS = {"sum": F.sum, "min": F.min, "max": F.max}


class WindowScan:
    def __init__(self, keys: tuple[str, ...] = ("session_id",), order: tuple[str, ...] = ORDER):
        self.keys, self.order = keys, order

    def scan(self, lines: DataFrame, *facts: Fact) -> DataFrame:
        return lines.withColumns(_window_columns(facts, self.keys, self.order))


class BlockScan:
    """Blocks cut by range partitioning into ``parts``, or as many as the session shuffles into."""

    def __init__(self, parts: int | None = None, keys: tuple[str, ...] = ("session_id",),
                 order: tuple[str, ...] = ORDER):
        self.parts, self.keys, self.order = parts, keys, order

    def scan(self, lines: DataFrame, *facts: Fact) -> DataFrame:
        names = lines.columns
        lines = lines.select("*", *[f.expr.alias(f"_x_{f.name}") for f in facts])
        cut = (*self.keys, *self.order)
        lines = lines.repartitionByRange(self.parts, *cut) if self.parts else lines.repartitionByRange(*cut)
        # Both branches below read this. The cut keeps a chain of scans from doubling the
        # work of the ones before, and fixes the ranges, which depend on a sample.
        lines = checkpoint(lines.withColumn("_blk", F.spark_partition_id()))
        position = F.struct(*self.order)
        inner = [Fact(f.name, f.kind, F.col(f"_x_{f.name}")) for f in facts]
        keys = [*self.keys, "_blk"]

        local = lines.withColumns(_window_columns(inner, tuple(keys), self.order)).withColumn(
            "_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*self.order)))
        summary = lines.groupBy(*keys).agg(*[_summary(f, position).alias(f"_s_{f.name}") for f in inner])
        carried = summary.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], *[self._carry(f).alias(f"_c_{f.name}") for f in inner])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = local.join(carried, same)
        return joined.select(*names, *[_stitch(f).alias(f.name) for f in inner])

    def _carry(self, fact: Fact) -> Column:
        value = F.col(f"_s_{fact.name}")
        blocks = Window.partitionBy(*self.keys).orderBy("_blk")
        back = Window.partitionBy(*self.keys).orderBy(F.desc("_blk"))
        before = (Window.unboundedPreceding, -1)
        if fact.kind == "prev":
            return F.lag(value).over(blocks)["v"]
        if fact.kind == "running":
            return F.sum(value).over(blocks.rowsBetween(*before))
        if fact.kind == "latest":
            return F.last(value, True).over(blocks.rowsBetween(*before))["v"]
        if fact.kind == "upcoming":
            return F.last(value, True).over(back.rowsBetween(*before))["v"]
        return TOTALS[fact.kind](value).over(Window.partitionBy(*self.keys))


def _window_columns(facts, keys: tuple[str, ...], order: tuple[str, ...]) -> dict[str, Column]:
    session = Window.partitionBy(*keys)
    forward = session.orderBy(*order)
    backward = session.orderBy(*[F.desc(c) for c in order])
    upto = (Window.unboundedPreceding, Window.currentRow)
    out = {}
    for f in facts:
        if f.kind == "prev":
            out[f.name] = F.lag(f.expr).over(forward)
        elif f.kind == "running":
            out[f.name] = F.sum(f.expr).over(forward.rowsBetween(*upto))
        elif f.kind == "latest":
            out[f.name] = F.last(f.expr, True).over(forward.rowsBetween(*upto))
        elif f.kind == "upcoming":
            # A frame that only grows, over the reversed order, is linear; one that ends
            # at the last row would be evaluated again for each row.
            out[f.name] = F.last(f.expr, True).over(backward.rowsBetween(*upto))
        else:
            out[f.name] = TOTALS[f.kind](f.expr).over(session)
    return out


def _summary(fact: Fact, position: Column) -> Column:
    boxed = F.struct(fact.expr.alias("v"))
    known = F.when(fact.expr.isNotNull(), position)
    if fact.kind == "prev":
        return F.max_by(boxed, position)
    if fact.kind == "running":
        return F.sum(fact.expr)
    if fact.kind == "latest":
        return F.when(F.count(fact.expr) > 0, F.max_by(boxed, known))
    if fact.kind == "upcoming":
        return F.when(F.count(fact.expr) > 0, F.min_by(boxed, known))
    return TOTALS[fact.kind](fact.expr)


def _stitch(fact: Fact) -> Column:
    here, carried = F.col(fact.name), F.col(f"_c_{fact.name}")
    if fact.kind == "prev":
        return F.when(F.col("_row") == 1, carried).otherwise(here)
    if fact.kind == "running":
        return F.when(carried.isNull(), here).otherwise(F.coalesce(here, F.lit(0)) + carried)
    if fact.kind in ("latest", "upcoming"):
        return F.coalesce(here, carried)
    return carried


#: Bits of a row number that one round of ``fold_ordered`` takes, and rounds for the 60 bits of a row number.
FOLD_BITS, FOLD_ROUNDS = 12, 5


def fold_ordered(rows: DataFrame, values: list[str], merge: Callable[[Column], dict[str, Column]],
                 keys: tuple[str, ...] = ("session_id",), order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per key: ``values`` of its rows put together in order.

    ``merge`` takes an array of structs, some neighbours in order, and gives the values of all of them; it must be
    associative. Rows are numbered along (keys, order), 4096 neighbours are merged, then as many of the results, and so
    on, so a task holds short lists of short values however long a key is. A null key is a key.
    """
    cut = rows.select(*keys, *order, *values).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # Stored, because the numbers depend on a sample of the rows.
    level = stored(cut.select(*keys, F.monotonically_increasing_id().alias("_at"), *values))
    for _ in range(FOLD_ROUNDS):
        level = level.withColumn("_up", F.shiftright("_at", FOLD_BITS)).groupBy(*keys, "_up").agg(
            F.sort_array(F.collect_list(F.struct("_at", *values))).alias("_m"))
        level = level.select(*keys, F.col("_up").alias("_at"), *[c.alias(v) for v, c in merge(F.col("_m")).items()])
    return level.drop("_at")


WINDOW = WindowScan()


def run_ordered(lines: DataFrame, chain: Callable[[DataFrame, object], DataFrame],
                max_lines: int = MAX_TASK_LINES, parts: int | None = None, max_bytes: int = MAX_TASK_BYTES) -> DataFrame:
    """Apply a chain of line rules with the plan each session's length, in lines and bytes, allows.

    For line tables whose sessions have no bound. Lines exploded from one text column need
    no measuring: Spark itself bounds a row, and so a session, to 2 GiB.
    """
    lengths = lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("_b"))
    giants = lengths.where((F.col("_n") > max_lines) | (F.col("_b") > max_bytes)).select(F.col("session_id").alias("_giant"))
    giants = stored(giants)
    if giants.isEmpty():
        return chain(lines, WINDOW)
    blocks = BlockScan(parts)
    if not fits_broadcast(giants):
        return chain(lines, blocks)
    named = F.broadcast(giants)
    same = F.col("session_id").eqNullSafe(F.col("_giant"))
    short = chain(lines.join(named, same, "left_anti"), WINDOW)
    long = chain(lines.join(named, same, "left_semi"), blocks)
    return short.unionByName(long)
