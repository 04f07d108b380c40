"""Savings, exit-code skew, content and retention over the session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistline.functions import metrics as M

MIN_BUCKET_RUNS = 50
SKEW_LIMIT = 2.0
RETENTION_DAYS = 14
DAY = 86_400


def live(shadow: bool = False) -> Column:
    """Shadow runs are counterfactual: either only they count or all others do."""
    is_shadow = F.coalesce(F.col("mode") == "Shadow", F.lit(False))
    return is_shadow if shadow else ~is_shadow


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
        F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"),
    ]


def _derived(df: DataFrame, per_million: float) -> DataFrame:
    raw, cmp = F.col("raw_bytes"), F.col("compressed_bytes")
    df = df.withColumns({"ratio": M.compression_ratio(raw, cmp), "tokens_saved": M.tokens_saved(raw, cmp)})
    return df.withColumn("usd_saved", M.usd_saved(F.col("tokens_saved"), per_million))


def gain_total(sessions: DataFrame, shadow: bool = False, per_million: float = M.USD_PER_MILLION) -> DataFrame:
    return _derived(sessions.where(live(shadow)).agg(*_sums()), per_million)


def gain_by_fingerprint(sessions: DataFrame, shadow: bool = False, top: int | None = 20,
                        per_million: float = M.USD_PER_MILLION) -> DataFrame:
    """Tokens come from the sums, not from the rows; ties go by fingerprint."""
    df = _derived(sessions.where(live(shadow)).groupBy("fingerprint").agg(*_sums()), per_million)
    df = df.orderBy(F.desc("tokens_saved"), "fingerprint")
    return df if top is None else df.limit(top)


def gain_rollup(sessions: DataFrame, shadow: bool = False, per_million: float = M.USD_PER_MILLION) -> DataFrame:
    return _derived(sessions.where(live(shadow)).rollup("fingerprint").agg(*_sums()), per_million)


def gain_daily(sessions: DataFrame) -> DataFrame:
    """Per UTC day; tokens are the sum of what each run saved."""
    saved = M.tokens_saved(F.col("raw_bytes"), F.col("compressed_bytes"))
    return sessions.groupBy(M.utc_date(F.col("started_at")).cast("string").alias("date")).agg(
        *_sums(), F.sum(saved).alias("tokens_saved"))


def exit_bucket_aggregates(sessions: DataFrame) -> DataFrame:
    ok = F.col("exit_code") == 0
    known = sessions.where("exit_code is not null")

    def part(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name)).otherwise(0)), F.lit(0)).cast("bigint")

    return known.groupBy("fingerprint").agg(
        F.count_if(ok).alias("ok_runs"), part(ok, "raw_bytes").alias("ok_raw"),
        part(ok, "compressed_bytes").alias("ok_cmp"),
        F.count_if(~ok).alias("fail_runs"), part(~ok, "raw_bytes").alias("fail_raw"),
        part(~ok, "compressed_bytes").alias("fail_cmp"))


def exit_code_skew(buckets: DataFrame, min_runs: int = MIN_BUCKET_RUNS) -> DataFrame:
    """How much worse failures compress than successes; neutral while a bucket is small."""
    enough = (F.col("ok_runs") >= min_runs) & (F.col("fail_runs") >= min_runs)
    sr = F.when(enough, M.compression_ratio(F.col("ok_raw"), F.col("ok_cmp"))).otherwise(0.0)
    fr = F.when(enough, M.compression_ratio(F.col("fail_raw"), F.col("fail_cmp"))).otherwise(0.0)
    df = buckets.select("fingerprint", sr.alias("success_ratio"), fr.alias("failure_ratio"))
    df = df.withColumn("skew_factor", F.when(
        F.col("success_ratio") > 0, F.col("failure_ratio") / F.col("success_ratio")).otherwise(0.0))
    return df.withColumn("needs_relearning", F.col("skew_factor") > SKEW_LIMIT)


def recent_sessions(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(limit)


def retention_estimate(sessions: DataFrame, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    old = sessions.where(F.col("started_at") < now - days * DAY)
    size = F.coalesce("raw_bytes", F.lit(0)) + F.coalesce("compressed_bytes", F.lit(0))
    return old.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def purge_expired(sessions: DataFrame, now: int, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Split by age: the rows to keep, and one row per content reference set free. Rows without a time are kept.

    For any table of rows; one that lies in folders of days is purged in place by ``sources.sessions.purge_sessions``.
    """
    expired = F.coalesce(F.col("started_at") < now - days * DAY, F.lit(False))
    refs = F.array_compact(F.array("raw_sha", "compressed_sha"))
    released = sessions.where(expired).select(F.explode(refs).alias("sha256"))
    released = released.where(F.col("sha256") != "").groupBy("sha256").agg(F.count(F.lit(1)).alias("released"))
    return sessions.where(~expired), released


def content_refcount(texts: DataFrame) -> DataFrame:
    """Identical bytes once, with the number of references. ``texts``: text, kind, created_at."""
    hashed = texts.select(M.content_hash(F.col("text")).alias("sha256"), "kind", "created_at",
                          F.octet_length("text").cast("bigint").alias("size"))
    return hashed.groupBy("sha256").agg(
        F.count(F.lit(1)).alias("ref_count"), F.min("created_at").alias("created_at"),
        F.min("size").alias("size"), F.min_by("kind", F.struct("created_at", "kind")).alias("kind"))


def content_total_bytes(content: DataFrame) -> DataFrame:
    return content.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def orphan_content(content: DataFrame, *references: DataFrame) -> DataFrame:
    """Content rows that nothing refers to. References are made distinct first, so a piece
    of content with most of the references is one row in the join."""
    used = references[0].select("sha256")
    for r in references[1:]:
        used = used.unionByName(r.select("sha256"))
    used = used.where("sha256 is not null and sha256 <> ''").distinct()
    return content.join(used, "sha256", "left_anti")


def release_content(content: DataFrame, released: DataFrame) -> DataFrame:
    """Reference counts after a purge; content without references is gone."""
    joined = content.join(released, "sha256", "left")
    left = F.col("ref_count") - F.coalesce("released", F.lit(0))
    return joined.withColumn("ref_count", left).where("ref_count > 0").drop("released")


def session_lookup(sessions: DataFrame, content: DataFrame, session_id: str) -> DataFrame:
    one = sessions.where(F.col("session_id") == session_id)
    return one.join(content.withColumnRenamed("sha256", "raw_sha"), "raw_sha", "left")


def drift_check(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored hash against the hash of the current body, per key. Keys without a stored hash
    are not reported."""
    now = current.select("key", F.sha2(F.col("body").cast("binary"), 256).alias("now_sha"))
    joined = stored.select("key", "sha").join(now, "key", "full_outer").where("sha is not null")
    status = F.when(F.col("now_sha").isNull(), "MISSING").when(
        F.col("now_sha") == F.col("sha"), "OK").otherwise("DRIFT")
    return joined.select("key", status.alias("status"))
