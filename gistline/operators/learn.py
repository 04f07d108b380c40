"""Learning rules from samples: lock-in, constant lines, derived rule sets.

A sample row: sample_id, fingerprint, captured_at, exit_code, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistline import schema
from gistline.functions.metrics import content_hash
from gistline.functions.regex import BACK_REFERENCE, LOOK_AROUND, escape
from gistline.functions.text import is_blank, with_check_lines
from gistline.session import lookup, stored

# Fixed values.
LOCK_IN = 5
FAST_LOCK_IN = 3
SAMPLE_CAP = 64
MAX_ANCHORS = 20
TRUNCATE_BYTES = 65_536
ERROR_WORDS = r"(?i)(error|fatal|panic|traceback)"
RULE_SCHEMA = "1.0"


def samples_in_order(samples: DataFrame, fingerprint: str) -> DataFrame:
    return samples.where(F.col("fingerprint") == fingerprint).orderBy("captured_at", "sample_id")


def sample_count(samples: DataFrame) -> DataFrame:
    return samples.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_samples"))


def sample_cap(samples: DataFrame, profiles: DataFrame | None = None, cap: int = SAMPLE_CAP) -> DataFrame:
    """Oldest ``cap`` samples per fingerprint, only for those without a profile.

    The rank limit is applied in each task before the shuffle, so a hot fingerprint sends
    ``cap`` rows per task.
    """
    if profiles is not None:
        known = profiles.select("fingerprint").distinct().withColumn("_known", F.lit(1))
        samples = lookup(samples, known, ["fingerprint"]).where("_known is null").drop("_known")
    oldest = Window.partitionBy("fingerprint").orderBy("captured_at", "sample_id")
    return samples.withColumn("_rn", F.row_number().over(oldest)).where(F.col("_rn") <= cap).drop("_rn")


def _hashes(samples: DataFrame) -> DataFrame:
    return samples.select("fingerprint", content_hash(F.col("text")).alias("sha"))


def zero_variance(samples: DataFrame) -> DataFrame:
    """All samples are the same bytes; smallest equals largest hash says so without a set."""
    return _hashes(samples).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_samples"), (F.min("sha") == F.max("sha")).alias("zero_variance"))


def lock_in_verdict(samples: DataFrame, n: int = LOCK_IN, fast_path: bool = True) -> DataFrame:
    df = zero_variance(samples)
    fast = F.lit(fast_path) & (F.col("n_samples") >= FAST_LOCK_IN) & F.col("zero_variance")
    reason = F.when(F.col("n_samples") >= n, "reached_n").when(fast, "zero_variance_fast_path").otherwise(
        "accumulating")
    return df.select("fingerprint", "n_samples", (reason != "accumulating").alias("should_lock"),
                     reason.alias("reason"))


def doubling_checkpoint(n: Column, base: int = LOCK_IN) -> Column:
    q = (n / base).cast("bigint")
    return (n >= base) & (n % base == 0) & (q.bitwiseAND(q - 1) == 0)


def _sample_lines(samples: DataFrame) -> DataFrame:
    split = with_check_lines(samples, "_l", F.col("text"))
    return split.select("fingerprint", "sample_id", "captured_at", F.posexplode_outer("_l").alias("line_no", "line")).where(
        "line_no is not null")


def classify_lines(samples: DataFrame) -> DataFrame:
    """Each line of the first sample: constant when every other sample has the same line at
    the same index.

    Per index the samples are compared through smallest, largest and earliest line, which
    partial sums can hold, so a fingerprint with most of the samples is no single group.
    """
    totals = samples.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("captured_at", "sample_id")).alias("first"))
    at = F.struct("captured_at", "sample_id")
    per_index = _sample_lines(samples).groupBy("fingerprint", "line_no").agg(
        F.count(F.lit(1)).alias("have"), F.min("line").alias("lo"), F.max("line").alias("hi"),
        F.min(at).alias("earliest"), F.min_by("line", at).alias("line"))
    # An index the first sample does not reach is not reported.
    joined = lookup(per_index, stored(totals), ["fingerprint"], "inner").where(F.col("earliest") == F.col("first"))
    constant = (F.col("have") == F.col("n")) & (F.col("lo") == F.col("hi"))
    return joined.select(
        "fingerprint", F.col("line_no").cast("bigint").alias("line_no"), "line",
        F.when(constant, "constant").otherwise("varying").alias("class"))


def constant_lines(samples: DataFrame) -> DataFrame:
    """Non-blank lines that occur, anywhere, in all samples of a fingerprint."""
    split = with_check_lines(samples, "_l", F.col("text"))
    seen = split.select("fingerprint", F.explode_outer(F.array_distinct("_l")).alias("line")).where("line is not null")
    counts = seen.where(~is_blank(F.col("line"))).groupBy("fingerprint", "line").agg(F.count(F.lit(1)).alias("c"))
    n = stored(sample_count(samples))
    return lookup(counts, n, ["fingerprint"], "inner").where("c = n_samples").select("fingerprint", "line")


def _rule(**fields) -> Column:
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.RULE.fields])


def _invariant(**fields) -> Column:
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.INVARIANT.fields])


def learn_profile(samples: DataFrame, max_anchors: int | None = MAX_ANCHORS, max_bytes: int = TRUNCATE_BYTES) -> DataFrame:
    """A rule set per fingerprint: colours off, keep the first ``max_anchors`` anchors (None: all), no
    blank lines, no repeats, a size limit; and two invariants."""
    first = Window.partitionBy("fingerprint").orderBy("line")
    anchors = constant_lines(samples).withColumn("rn", F.row_number().over(first)).where(
        F.col("rn") <= F.lit(max_anchors) if max_anchors is not None else F.lit(True)).groupBy("fingerprint").agg(
        F.array_sort(F.collect_list("line")).alias("anchors"))
    df = samples.select("fingerprint").distinct().join(anchors, "fingerprint", "left")
    pattern = F.concat(F.lit("^("), F.array_join(F.transform("anchors", escape), "|"), F.lit(")$"))
    rules = F.array_compact(F.array(
        _rule(kind=F.lit("strip_ansi")),
        F.when(F.col("anchors").isNotNull(), _rule(kind=F.lit("keep_lines"), pattern=pattern)),
        _rule(kind=F.lit("drop_lines"), pattern=F.lit(r"^\s*$")),
        _rule(kind=F.lit("dedup")),
        _rule(kind=F.lit("truncate_to"), bytes=F.lit(max_bytes)),
    ))
    invariants = F.array(
        _invariant(name=F.lit("ErrorLinesPreserved"), check=F.lit("all_matching_preserved"),
                   pattern=F.lit(ERROR_WORDS)),
        _invariant(name=F.lit("ExitLinePreserved"), check=F.lit("exit_line_preserved")),
    )
    return df.select("fingerprint", F.lit("1.0.0").alias("version"), F.lit(RULE_SCHEMA).alias("schema"),
                     F.lit("plain").alias("format_claim"), rules.alias("rules"), invariants.alias("invariants"))


def learning_runs(samples: DataFrame, verdicts: DataFrame, self_tests: DataFrame, at: int) -> DataFrame:
    """Outcome per fingerprint: accumulating, rejected by its self-test, or locked in."""
    df = verdicts.join(self_tests.select("fingerprint", "passed"), "fingerprint", "left")
    outcome = F.when(~F.col("should_lock"), "accumulating").when(
        F.coalesce("passed", F.lit(False)), "locked_in").otherwise("rejected")
    error = F.when(outcome == "rejected", "self-test failed on a sample")
    return df.select("fingerprint", F.lit("structural").alias("backend"), outcome.alias("outcome"),
                     "n_samples", error.alias("error_detail"), F.lit(at).cast("bigint").alias("at"))


def _bad_pattern(p: Column) -> Column:
    return p.rlike(BACK_REFERENCE) | p.rlike(LOOK_AROUND)


def _bad_path(p: Column) -> Column:
    return ~p.startswith("$") | p.contains("*") | p.contains("?(") | p.contains("..") | p.contains("@")


def profile_rule_checks(profiles: DataFrame) -> DataFrame:
    """Violations in a rule table: (profile_id, where, problem), one row each."""
    p = profiles
    meta = p.select("profile_id", F.lit("meta").alias("where"), F.explode(F.array_compact(F.array(
        F.when(F.coalesce(F.col("schema") != RULE_SCHEMA, F.lit(True)), "unsupported schema"),
        F.when(is_blank(F.coalesce("fingerprint", F.lit(""))), "empty fingerprint"),
        F.when(is_blank(F.coalesce("version", F.lit(""))), "empty version"),
    ))).alias("problem"))

    rules = p.select("profile_id", F.posexplode("rules").alias("i", "r"))
    kind = F.col("r.kind")
    none = F.array().cast("array<string>")
    states = F.coalesce("r.states", F.array().cast(schema.RULE["states"].dataType))
    patterns = F.array_compact(F.concat(
        F.array("r.pattern", "r.pattern2"),
        F.flatten(F.transform(states, lambda s: F.concat(
            F.array(s["enter"]), F.coalesce(s["keep"], none), F.coalesce(s["drop"], none))))))
    names = F.transform(states, lambda s: s["name"])
    paths = F.coalesce("r.paths", none)
    needs_n = kind.isin("head", "tail", "head_after", "tail_before")
    problems = F.array_compact(F.array(
        F.when(~kind.isin(*schema.RULE_KINDS), "unknown kind"),
        F.when(needs_n & (F.coalesce("r.n", F.lit(0)) <= 0), "n must be > 0"),
        F.when((kind == "truncate_to") & (F.coalesce("r.bytes", F.lit(0)) <= 0), "bytes must be > 0"),
        F.when((kind == "collapse_repeated") & (F.coalesce("r.min", F.lit(3)) < 2), "min must be >= 2"),
        F.when((kind == "state_machine") & (F.size(states) == 0), "no states"),
        F.when((kind == "state_machine") & (F.size(F.array_distinct(names)) < F.size(names)), "duplicate state"),
        F.when((kind == "ndjson_filter") & is_blank(F.coalesce("r.field", F.lit(""))), "empty field"),
        F.when((kind == "ndjson_filter") & (F.size(F.coalesce("r.keep_values", none)) == 0), "empty keep_values"),
        F.when(F.exists(paths, _bad_path), "unsupported json path"),
        F.when(F.exists(patterns, _bad_pattern), "forbidden pattern construct"),
    ))
    per_rule = rules.select("profile_id", F.concat(F.lit("rule "), F.col("i").cast("string")).alias("where"),
                            F.explode(problems).alias("problem"))

    checks = p.select("profile_id", F.explode("invariants").alias("v"))
    where = F.concat(F.lit("invariant "), F.col("v.name"))
    per_check = checks.select("profile_id", where.alias("where"), F.explode(F.array_compact(F.array(
        F.when(~F.col("v.check").isin(*schema.CHECK_KINDS), "unknown check"),
        F.when(F.coalesce(_bad_pattern(F.col("v.pattern")), F.lit(False)), "forbidden pattern construct"),
        F.when((F.col("v.check") == "json_path_exists") & _bad_path(F.coalesce("v.path", F.lit(""))),
               "unsupported json path"),
    ))).alias("problem"))
    twice = checks.groupBy("profile_id", where.alias("where")).agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("profile_id", "where", F.lit("duplicate invariant").alias("problem"))
    return meta.unionByName(per_rule).unionByName(per_check).unionByName(twice)
