"""Command fingerprints: the binary plus its arguments with the variable parts folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHAPE_FLAGS = ("--format", "--output", "-o", "--json", "--pretty", "--oneline")
NUMBER = r"(?dU)^-?\d+(\.\d+)?\z"
HEX = r"(?dU)^[0-9a-fA-F]{6,}\z"
URL = r"(?dU)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+).*\z"
PATH = (
    r"(?dU)^(\.{1,2}[/\\]|[/\\~]|[A-Za-z]:[/\\]|[\w.-]+[/\\][\w./\\-]+|"
    r"\w[\w.-]*\.(rs|py|js|ts|go|java|c|cpp|h|toml|json|yaml|yml|md|txt|log|lock|gradle|xml|sh))\z"
)


def canonical_token(token: Column) -> Column:
    """First hit wins: number, hash, address, path, quoted text, else the token itself."""
    return (
        F.when(token.rlike(NUMBER), F.lit("<n>"))
        .when(token.rlike(HEX), F.lit("<hash>"))
        .when(token.rlike(URL), F.concat(
            F.regexp_extract(token, URL, 1), F.lit("://"), F.regexp_extract(token, URL, 2)))
        .when(token.rlike(PATH) | token.contains("/") | token.contains("\\"), F.lit("<path>"))
        .when(token.contains(" ") | token.contains("\t"), F.lit("<str>"))
        .otherwise(token)
    )


def canonical_argv(tail: Column) -> Column:
    """Fold each argument by looking at it and at the one before it.

    An argument is a flag's value exactly when the previous one starts with ``-`` and has
    no ``=`` and it does not start with ``-`` itself, so no running state is needed.
    """

    def one(token: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tail, i - 1))
        is_flag = token.startswith("-")
        key = F.substring_index(token, "=", 1)
        value = F.substr(token, F.length(key) + 2)
        inline = F.when(key.isin(*SHAPE_FLAGS), token).otherwise(
            F.concat(key, F.lit("="), canonical_token(value)))
        shaped = F.coalesce(~is_flag & before.isin(*SHAPE_FLAGS), F.lit(False))
        return (
            F.when(is_flag & token.contains("="), inline)
            .when(is_flag | shaped, token)
            .otherwise(canonical_token(token))
        )

    return F.transform(tail, one)


def file_stem(path: Column) -> Column:
    """Last path component without its last extension; a leading dot is part of the stem."""
    trimmed = F.regexp_replace(path, r"(?:/+\.?)+\z", "")
    name = F.element_at(F.split(trimmed, "/"), -1)
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")
    return F.when(name.isin("", ".", ".."), path).otherwise(stem)


def fingerprint(argv: Column) -> Column:
    tail = F.when(F.size(argv) > 1, F.slice(argv, 2, F.greatest(F.size(argv) - 1, F.lit(1))))
    binary = file_stem(F.get(argv, F.lit(0)))
    return (
        F.when(F.size(argv) <= 0, F.lit("<empty>"))
        .when(F.size(argv) == 1, binary)
        .otherwise(F.concat_ws(" ", binary, F.array_join(canonical_argv(tail), " ")))
    )
