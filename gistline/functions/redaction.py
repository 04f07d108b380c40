"""Secret redaction on whole texts, before they are split into lines."""

from __future__ import annotations

import re._constants as C
import re._parser as parser
import warnings
from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistline.functions.regex import PatternError, translate

# Secret shapes in the order they are applied.
SECRETS = (
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("github_pat_classic", r"ghp_[A-Za-z0-9]{36,}"),
    ("github_pat_fine", r"github_pat_[A-Za-z0-9_]{40,}"),
    ("gitlab_token", r"glpat-[A-Za-z0-9_-]{20,}"),
    ("stripe_live", r"sk_live_[A-Za-z0-9]{20,}"),
    ("stripe_test", r"sk_test_[A-Za-z0-9]{20,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.+/=-]{10,}"),
    ("bearer_header", r"(?i)(authorization|auth)\s*:\s*bearer\s+[A-Za-z0-9._~+/=-]{20,}"),
    ("ssh_private_key_block",
     r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
)
LONG_TOKEN = r"\b[A-Za-z0-9_+/=-]{32,}\b"
DENY_TOKEN = r"\b[A-Za-z0-9_+/=-]{24,}\b"
ENTROPY_LIMIT = 4.5


def shannon_entropy(text: Column) -> Column:
    """Bits per byte of the UTF-8 text. Each byte is read as one letter; a letter is counted by what is left without it."""
    letters = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    n = F.octet_length(text)
    bits = F.transform(
        F.filter(F.array_distinct(F.split(letters, "")), lambda c: c != ""),
        lambda c: F.lit(1.0) * (n - F.length(F.replace(letters, c, F.lit("")))) / n,
    )
    total = F.aggregate(bits, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(F.octet_length(text) == 0, F.lit(0.0)).otherwise(total)


def required_literal(pattern: str) -> tuple[str, bool]:
    """The longest text that every hit of a pattern holds, and whether its case is free."""
    tree = parser.parse(pattern)
    runs = [""]
    for op, value in tree:
        if op is C.LITERAL:
            runs[-1] += chr(value)
        else:
            runs.append("")
    return max(runs, key=len), bool(tree.state.flags & parser.SRE_FLAG_IGNORECASE)


def may_hold_secret(text: Column) -> Column:
    """Whether a text holds what some secret shape cannot do without. A plain search for a few literals is several
    times cheaper than the shapes, or than one alternation of the literals."""
    out = F.lit(False)
    for literal, fold in (required_literal(p) for _, p in SECRETS):
        out = out | (F.lower(text).contains(literal.lower()) if fold else text.contains(literal))
    return out


def redact_named(text: Column) -> Column:
    """Secret shapes, one after another, in texts that may hold one; nearly all of them are returned as they are."""
    out = text
    for name, pattern in SECRETS:
        out = F.regexp_replace(out, translate(pattern), f"[REDACTED:{name}]")
    return F.when(may_hold_secret(text), out).otherwise(text)


def redact_high_entropy(text: Column) -> Column:
    """Mask long tokens by position: gaps and tokens are zipped back together, so a masked
    token that occurs inside a kept one cannot damage it. Texts without a long token,
    nearly all of them, are returned as they are."""
    pattern = translate(LONG_TOKEN)
    tokens = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    gaps = F.split(text, pattern, -1)
    masked = F.transform(tokens, lambda t: F.when(
        shannon_entropy(t) > ENTROPY_LIMIT, F.lit("[REDACTED:high_entropy]")).otherwise(t))
    joined = F.array_join(F.zip_with(gaps, masked, lambda g, t: F.concat(g, t)), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def redact_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Both passes over a text column. They are two steps because the second reads its input
    several times, and in one expression the first would be computed for each."""
    named = df.withColumn(column, redact_named(F.col(column)))
    return named.withColumn(column, redact_high_entropy(F.col(column)))


def redact_user(text: Column, patterns: Iterable[str]) -> Column:
    """Apply configured patterns; one that is not a valid pattern is reported and skipped."""
    for pattern in patterns:
        source = valid_pattern(pattern)
        if source is None:
            warnings.warn(f"not a valid pattern, skipped: {pattern}", stacklevel=2)
        else:
            text = F.regexp_replace(text, source, "[REDACTED:user]")
    return text


def valid_pattern(pattern: str) -> str | None:
    """The translated pattern, or None if it is refused or does not compile."""
    try:
        source = translate(pattern)
    except PatternError:
        return None
    probe = SparkSession.active().range(1).select(F.regexp_count(F.lit(""), F.lit(source)))
    try:
        probe.collect()
    except PySparkException as error:
        if "REGEX" in (error.getCondition() or "") or "PatternSyntax" in str(error) or "INVALID_PARAMETER" in (error.getCondition() or ""):
            return None
        raise
    return source


def redact_deny_sweep(text: Column) -> Column:
    return F.regexp_replace(text, translate(DENY_TOKEN), "[REDACTED:deny]")

