"""Classes of command strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistline.functions.fingerprint import file_stem
from gistline.functions.regex import matches
from gistline.functions.text import TAG

# Fixed values.
BUILTINS = (
    "cd", "export", "set", "unset", "alias", "source", ".", "eval", "pwd", "echo", "printf",
    "read", "exit", "return",
)
PLUMBING = ("tee", "cat")


def first_token(command: Column) -> Column:
    return F.regexp_extract(command, r"^[ \t\n\f\r]*([^ \t\n\f\r]+)", 1)


def passthrough_class(command: Column, patterns: Iterable[str] = (), tag: str = TAG) -> Column:
    """Why a command is left alone, or ``wrap``. The first reason wins; no command at all
    counts as a builtin."""
    trimmed = F.regexp_replace(command, r"(?U)^\s+", "")
    first = first_token(trimmed)
    escape = f"{tag.upper()}_RAW=1"
    raw = trimmed.startswith(f"{escape} ") | trimmed.startswith(f"{escape}\t")
    wrapped = (
        trimmed.startswith(f"{tag} ") | (trimmed == tag)
        | first.endswith(f"/{tag}") | first.endswith(f"/{tag}.exe")
        | first.endswith(f"\\{tag}") | first.endswith(f"\\{tag}.exe")
        | (F.lower(file_stem(first)) == tag)
    )
    plumbing = first.isin(*PLUMBING) & trimmed.rlike("[<>|]")
    out = (
        F.when(raw, "raw_escape").when(wrapped, "already_wrapped")
        .when((first == "") | first.isin(*BUILTINS), "builtin")
        .when(plumbing, "pipeline_plumbing")
    )
    for pattern in patterns:
        out = out.when(matches(trimmed, pattern), "user_passthrough")
    return out.otherwise("wrap")
