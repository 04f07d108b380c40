"""Line patterns: one dialect for every rule.

Patterns are written in a linear-time dialect (no look-around, no back-references; ``\\n`` is
the only line end; classes, boundaries and case folding are Unicode-aware). The JVM needs the
flags ``d`` and ``U`` for that, and would accept the refused constructs, so they are refused here. It also tries one way
through a pattern after another; patterns whose ways grow too fast with a line are refused before they meet one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions.ambiguity import EXPONENTIAL, Unreadable, growth

FLAGS = "(?dU)"

# What a pattern may not contain, as patterns of the JVM dialect.
BACK_REFERENCE = r"(?<!\\)(?:\\\\)*\\[1-9]"
LOOK_AROUND = r"\(\?(?:[=!>]|<[=!])"


# The named classes of bracket expressions, ASCII only.
NAMED_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
NAMED_CLASS = r"\[:(\^?)([a-z]+):\]"
# Set difference inside a class has no counterpart in the JVM.
SET_DIFFERENCE = r"\[[^\]\\]*(?:--|~~)[^\]]*\["


class PatternError(ValueError):
    pass


def portable(pattern: str) -> bool:
    names = [m[2] for m in re.finditer(NAMED_CLASS, pattern)]
    return not any(re.search(p, pattern) for p in (BACK_REFERENCE, LOOK_AROUND, SET_DIFFERENCE)) and all(
        n in NAMED_CLASSES for n in names)


#: Highest power of a line's length that the ways through a pattern may grow with.
MAX_GROWTH = 3


@lru_cache(maxsize=4096)
def problem(pattern: str) -> str | None:
    """Why a pattern is refused, or None."""
    if not portable(pattern):
        return "look-around, back-references, set differences and unknown classes are refused"
    try:
        ways = growth(re.sub(NAMED_CLASS, lambda m: _named(m[1], m[2]), pattern))
    except Unreadable as error:
        return f"not a pattern: {error}"
    if ways == EXPONENTIAL:
        return "its ways double with each repeat of a word"
    return f"its ways grow with the power {ways} of a line" if ways > MAX_GROWTH else None


def refused(patterns: DataFrame) -> DataFrame:
    """(pattern, problem) of the refused ones in a table (pattern), whatever their number; nulls are none."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, why) for p in batch.column(0).to_pylist() if (why := problem(p)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["pattern", "problem"])

    return patterns.where("pattern is not null").distinct().mapInArrow(check, "pattern string, problem string")


def _named(negated: str, name: str) -> str:
    return f"[^{NAMED_CLASSES[name]}]" if negated else NAMED_CLASSES[name]


def translate(pattern: str) -> str:
    why = problem(pattern)
    if why:
        raise PatternError(f"{why}: {pattern}")
    return FLAGS + re.sub(NAMED_CLASS, lambda m: _named(m[1], m[2]), pattern.replace("(?P<", "(?<"))


def escape(text: Column) -> Column:
    """Escape a text so that it matches itself inside a pattern."""
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


def translate_column(pattern: Column) -> Column:
    """``translate`` for patterns held in a table; applied to the table, not to each line."""
    out = F.replace(pattern, F.lit("(?P<"), F.lit("(?<"))
    for name in NAMED_CLASSES:
        for sign in ("", "^"):
            out = F.replace(out, F.lit(f"[:{sign}{name}:]"), F.lit(_named(sign, name)))
    return F.concat(F.lit(FLAGS), out)


def matches(text: Column, pattern: str | Column) -> Column:
    """Unanchored hit. A column holds translated patterns and uses ``regexp_instr``, which
    keeps the compiled pattern while its value stays the same; ``rlike`` would compile it
    for every row."""
    if isinstance(pattern, str):
        return text.rlike(translate(pattern))
    return F.coalesce(F.regexp_instr(text, pattern) > 0, F.lit(False))
