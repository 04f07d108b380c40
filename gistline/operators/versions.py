"""Life of a profile: versions, status changes, usage, listing.

Status changes return a new snapshot of the table; the caller writes it and switches to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.session import lookup


def _newest_first() -> list:
    return [F.desc("created_at"), F.desc("profile_id")]


def active_profile(profiles: DataFrame) -> DataFrame:
    """Newest active row per fingerprint. Ties in time go to the higher id."""
    columns = profiles.columns
    best = F.max_by(F.struct(*columns), F.struct("created_at", "profile_id"))
    return profiles.where("status = 'active'").groupBy("fingerprint").agg(best.alias("p")).select("p.*")


def promote(profiles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate id becomes active; what was active for its fingerprint is superseded.
    With several candidates for a fingerprint the last id wins, as if promoted in turn."""
    marked = profiles.join(candidates.select("profile_id").distinct().withColumn("_cand", F.lit(True)),
                           "profile_id", "left")
    new = marked.where("_cand").groupBy("fingerprint").agg(F.max("profile_id").alias("_new"))
    df = lookup(marked, new, ["fingerprint"])
    status = (
        F.when(F.col("profile_id") == F.col("_new"), "active")
        .when(F.col("_cand"), "superseded")
        .when(F.col("_new").isNotNull() & (F.col("status") == "active"), "superseded")
        .otherwise(F.col("status")))
    return df.withColumn("status", status).select(profiles.columns)


def rollback(profiles: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """The newest superseded row becomes active and the active one superseded; a
    fingerprint without a superseded row does not change."""
    back = profiles.where("status = 'superseded'").groupBy("fingerprint").agg(
        F.max_by("profile_id", F.struct("created_at", "profile_id")).alias("_back"))
    if fingerprints is not None:
        back = back.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi")
    df = lookup(profiles, back, ["fingerprint"])
    status = (
        F.when(F.col("profile_id") == F.col("_back"), "active")
        .when(F.col("_back").isNotNull() & (F.col("status") == "active"), "superseded")
        .otherwise(F.col("status")))
    return df.withColumn("status", status).select(profiles.columns)


def revoke_profile(profiles: DataFrame, fingerprint: str) -> DataFrame:
    """Quarantine the profile that is in use for a fingerprint."""
    newest = active_profile(profiles.where(F.col("fingerprint") == fingerprint)).select(
        "profile_id", F.lit(True).alias("_hit"))
    df = profiles.join(F.broadcast(newest), "profile_id", "left")  # one row at most
    return df.withColumn("status", F.when(F.col("_hit"), "quarantined").otherwise(F.col("status"))).select(
        profiles.columns)


def purge_profile(profiles: DataFrame, fingerprint: str) -> DataFrame:
    return profiles.where(F.col("fingerprint") != fingerprint)


def set_status(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: profile_id, status."""
    new = changes.groupBy("profile_id").agg(F.max("status").alias("_status"))
    df = profiles.join(new, "profile_id", "left")
    return df.withColumn("status", F.coalesce("_status", "status")).select(profiles.columns)


def profile_history(profiles: DataFrame, fingerprint: str) -> DataFrame:
    return profiles.where(F.col("fingerprint") == fingerprint).orderBy(*_newest_first())


def profile_listing(bundled: DataFrame, stored: DataFrame) -> DataFrame:
    columns = ["fingerprint", "version", "provenance", "status", "created_at", "profile_id"]
    both = bundled.select(*columns).unionByName(stored.select(*columns))
    return both.orderBy("fingerprint", *_newest_first())


def profile_usage(sessions: DataFrame, samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Last use and use count from the session facts, sample count from the samples of the
    fingerprint while the profile is active."""
    used = sessions.where("profile_id is not null").groupBy("profile_id").agg(
        F.max("started_at").alias("last_used_at"), F.count(F.lit(1)).alias("uses"))
    counts = samples.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    df = lookup(profiles.select("profile_id", "fingerprint", "status").join(used, "profile_id", "left"),
                counts, ["fingerprint"])
    return df.select(
        "profile_id", "fingerprint", "last_used_at", F.coalesce("uses", F.lit(0)).alias("uses"),
        F.when(F.col("status") == "active", F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("sample_count"))
