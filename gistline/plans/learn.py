"""Learn rule sets for all fingerprints at once, and test them on their own samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.operators import judge as G
from gistline.operators import learn as L
from gistline.operators.lines import explode_lines
from gistline.session import checkpoint, lookup, stored
from gistline.plans.reduce import MAX_BYTES, MAX_STEPS, apply_rules, budget_guard, compile_rules, rule_cost


def as_profiles(learned: DataFrame, created_at: int, status: str = "pending") -> DataFrame:
    """Learned rule sets as stored profile rows; the id follows from the fingerprint."""
    return learned.select(
        F.abs(F.xxhash64("fingerprint")).alias("profile_id"), "fingerprint", "version", "schema",
        F.lit("synthesized").alias("provenance"), F.lit(status).alias("status"),
        F.lit(created_at).cast("bigint").alias("created_at"), "format_claim", "rules", "invariants")


def self_test(samples: DataFrame, profiles: DataFrame, max_steps: int = MAX_STEPS,
              max_bytes: int = MAX_BYTES) -> DataFrame:
    """Apply each candidate to all samples of its fingerprint; one failed invariant or one
    sample over the budget rejects it. One row per fingerprint."""
    table = compile_rules(profiles)
    sessions = table.attach(samples.select(
        F.col("sample_id").cast("string").alias("session_id"), "fingerprint", "text"),
        ["rule_key"], "fingerprint", "inner").withColumn("profile_id", F.col("rule_key"))
    sessions = stored(sessions)  # read by every check below; the samples themselves are read once
    lines = explode_lines(sessions, keep=("rule_key", "profile_id"))
    reduced = checkpoint(apply_rules(lines, table))  # read by several checks
    raw = explode_lines(sessions, True, ("profile_id",))
    checks = table.rules.select(F.col("rule_key").alias("profile_id"), "invariants")
    results = G.invariant_results(raw, reduced, sessions, checks)
    failed = results.where(~F.col("passed")).select("session_id").distinct()
    guard = budget_guard(rule_cost(lines, table), max_steps, max_bytes)
    bad = failed.unionByName(guard.where("aborted").select("session_id")).distinct().withColumn("bad", F.lit(1))
    df = sessions.select("session_id", "fingerprint").join(bad, "session_id", "left")
    return df.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_samples"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("failures"),
        (F.coalesce(F.sum("bad"), F.lit(0)) == 0).alias("passed"))


def learn(samples: DataFrame, created_at: int) -> tuple[DataFrame, DataFrame]:
    """New profiles (active, self-tested) and the outcome of the run per fingerprint."""
    verdicts = L.lock_in_verdict(samples)
    verdicts = stored(verdicts)
    ready = verdicts.where("should_lock").select("fingerprint")
    locked = stored(lookup(samples, ready, ["fingerprint"], "inner").select(samples.columns))  # the input is read no more
    candidates = as_profiles(L.learn_profile(locked), created_at)
    tests = checkpoint(self_test(locked, candidates))
    passed = tests.where("passed").select("fingerprint")
    profiles = candidates.join(passed, "fingerprint", "left_semi").withColumn("status", F.lit("active"))
    return profiles, L.learning_runs(samples, verdicts, tests, created_at)
