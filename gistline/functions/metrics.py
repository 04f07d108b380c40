"""Bytes, tokens, money, hashes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
USD_PER_MILLION = 15.0


def tokens_saved(raw: Column, compressed: Column) -> Column:
    diff = F.coalesce(raw, F.lit(0)) - F.coalesce(compressed, F.lit(0))
    # A shift by two is an exact integer division by four; a division would go through double.
    return F.shiftright(F.greatest(diff, F.lit(0)).cast("bigint"), 2)


def compression_ratio(raw: Column, compressed: Column) -> Column:
    return F.when(raw == 0, F.lit(0.0)).otherwise(compressed.cast("double") / raw.cast("double"))


def usd_saved(tokens: Column, per_million: float = USD_PER_MILLION) -> Column:
    return tokens.cast("double") * F.lit(per_million) / F.lit(1_000_000.0)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def utc_date(epoch_seconds: Column) -> Column:
    """The civil day in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(((epoch_seconds - F.pmod(epoch_seconds, F.lit(86400))) / 86400).cast("int"))
