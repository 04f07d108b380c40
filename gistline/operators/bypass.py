"""Signals that a reader worked around the reduction, and the scores made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistline.functions.fingerprint import file_stem
from gistline.functions.text import TAG
from gistline.operators.scan import BlockScan, prev, running
from gistline.session import checkpoint

# Signal weights.
WEIGHTS = {
    "raw_re_fetch": 0.9,
    "show_raw": 0.7,
    "script_to_disk": 0.6,
    "grep_after_read": 0.5,
    "near_duplicate": 0.4,
    "raw_escape": 0.2,
}
READERS = ("cat", "head", "tail", "less", "more")
SEARCHERS = ("grep", "rg")
WINDOW_RUNS = 100
WARMUP_RUNS = 3
THRESHOLD = 0.3
NEAR_SECONDS = 30
NEAR_RUNS = 3


def weight_of(signal: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in WEIGHTS.items():
        out = F.when(signal == name, F.lit(weight)).otherwise(out)
    return out


def raw_re_fetch(argv: Column, tag: str = TAG) -> Column:
    binary = file_stem(F.get(argv, F.lit(0)))
    return binary.isin(*READERS) & F.exists(argv, lambda a: a.contains(tag) | a.contains("sess_"))


def grep_after_read(argv: Column) -> Column:
    return file_stem(F.get(argv, F.lit(0))).isin(*SEARCHERS)


def near_duplicate_global(runs: DataFrame, seconds: int = NEAR_SECONDS) -> DataFrame:
    """Same fingerprint among the three runs before, of any fingerprint, started at most
    ``seconds`` ago. Rows carry run_id, fingerprint, started_at.

    The order is over the whole table, so it is cut by range into even blocks, however
    uneven the times are. The cut depends on a sample and is fixed by a checkpoint; then
    each block looks back inside itself and the last three rows before it come along.
    """
    ordered = runs.select("run_id", "fingerprint", "started_at").repartitionByRange("started_at", "run_id")
    blocks = checkpoint(ordered.withColumn("blk", F.spark_partition_id()))
    inside = Window.partitionBy("blk").orderBy("started_at", "run_id")
    item = F.struct("fingerprint", "started_at")
    local = blocks.withColumn("row", F.row_number().over(inside)).withColumns({
        f"p{k}": F.lag(item, k).over(inside) for k in range(1, NEAR_RUNS + 1)})
    ends = blocks.withColumn("from_end", F.row_number().over(
        Window.partitionBy("blk").orderBy(F.desc("started_at"), F.desc("run_id")))).where(
        F.col("from_end") <= NEAR_RUNS)
    tails = ends.groupBy("blk").agg(F.array_compact(F.array(*[
        F.max(F.when(F.col("from_end") == k, item)) for k in range(1, NEAR_RUNS + 1)])).alias("t"))
    # One row per block here, as many as the shuffle has partitions.
    over = Window.orderBy("blk")
    empty = F.array().cast("array<struct<fingerprint:string,started_at:bigint>>")
    carry = tails.select("blk", F.concat(*[
        F.coalesce(F.lag("t", k).over(over), empty) for k in range(1, NEAR_RUNS + 1)]).alias("carry"))
    joined = local.join(carry, "blk")
    hits = F.lit(0)
    for k in range(1, NEAR_RUNS + 1):
        back = F.when(F.col("row") > k, F.col(f"p{k}")).otherwise(
            F.get(F.col("carry"), F.greatest(F.lit(k) - F.col("row"), F.lit(0))))
        near = (back["fingerprint"] == F.col("fingerprint")) & (
            F.col("started_at") - back["started_at"] <= seconds)
        hits = hits + F.coalesce(near, F.lit(False)).cast("int")
    return joined.select("run_id", "fingerprint", "started_at", hits.cast("bigint").alias("near_hits"))


def near_duplicate_by_agent(runs: DataFrame, seconds: int = NEAR_SECONDS) -> DataFrame:
    """The scaled form: an earlier run of the same agent and fingerprint at most ``seconds``
    ago. Only the latest earlier run matters, so it is a look-back and no join of pairs."""
    order = BlockScan(keys=("agent", "fingerprint"), order=("started_at", "run_id"))
    df = order.scan(runs, prev("last_at", F.col("started_at")))
    near = F.coalesce(F.col("started_at") - F.col("last_at") <= seconds, F.lit(False))
    return df.withColumn("near_duplicate", near).drop("last_at")


def number_runs(runs: DataFrame) -> DataFrame:
    """Runs of each profile numbered 1, 2, ... by time; ties go by session."""
    order = BlockScan(keys=("profile_id",), order=("at", "session_id"))
    return order.scan(runs, running("run_no", F.lit(1).cast("bigint")))


def bypass_events(runs: DataFrame) -> DataFrame:
    """One row per signal seen. ``runs``: session_id, argv, raw_escape, near_duplicate."""
    argv = F.col("argv")
    signals = F.array_compact(F.array(
        F.when(F.col("raw_escape"), F.lit("raw_escape")),
        F.when(raw_re_fetch(argv), F.lit("raw_re_fetch")),
        F.when(grep_after_read(argv), F.lit("grep_after_read")),
        F.when(F.col("near_duplicate"), F.lit("near_duplicate")),
    ))
    rows = runs.select("session_id", F.explode(signals).alias("signal"))
    return rows.withColumn("weight", weight_of(F.col("signal")))


def session_scores(events: DataFrame) -> DataFrame:
    """Capped bypass weight per (profile, session), over sessions with any event."""
    bypass = F.when(F.col("kind") == "bypass_signal", F.col("weight"))
    return events.where("session_id is not null").groupBy("profile_id", "session_id").agg(
        F.max("at").alias("latest"),
        F.least(F.coalesce(F.sum(bypass), F.lit(0.0)), F.lit(1.0)).alias("score"))


def rolling_bypass_score(events: DataFrame, window: int = WINDOW_RUNS) -> DataFrame:
    """Mean capped score of the newest sessions per profile; ties in time go by session."""
    newest = Window.partitionBy("profile_id").orderBy(F.desc("latest"), "session_id")
    # rank <= n is applied by every task before the shuffle, so a profile that holds most
    # of the sessions sends only n rows per task.
    ranked = session_scores(events).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= window)
    return ranked.groupBy("profile_id").agg(
        (F.sum("score") / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("n_sessions"))


def bypass_score_over_time(runs: DataFrame, window: int = WINDOW_RUNS, warmup: int = WARMUP_RUNS,
                           block_runs: int = 100_000) -> DataFrame:
    """Score after every run: the first ``warmup`` runs are ignored, then the mean of the
    last ``window`` capped scores.

    ``runs``: profile_id, run_no (1, 2, ... per profile), score. The run number gives the
    blocks: each holds ``block_runs`` runs, and a run also goes to the look-back of every later block
    that its window reaches, so a profile with most of the runs is spread over many tasks.
    """
    counted = runs.where(F.col("run_no") > warmup).withColumn("blk", F.floor(F.col("run_no") / block_runs))
    homes = F.sequence(F.col("blk"), F.floor((F.col("run_no") + (window - 1)) / block_runs))
    spread = counted.withColumn("home", F.explode(homes))
    frame = Window.partitionBy("profile_id", "home").orderBy("run_no").rowsBetween(-(window - 1), 0)
    scored = spread.withColumn("bypass_score", F.avg("score").over(frame))
    return scored.where(F.col("home") == F.col("blk")).select("profile_id", "run_no", "bypass_score")


def distinct_sessions_per_profile(events: DataFrame) -> DataFrame:
    pairs = events.where("session_id is not null").select("profile_id", "session_id").distinct()
    return pairs.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_sessions"))


def event_count_per_profile(events: DataFrame) -> DataFrame:
    return events.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_events"))


def bypass_quarantine(events: DataFrame, threshold: float = THRESHOLD, warmup: int = WARMUP_RUNS,
                      window: int = WINDOW_RUNS) -> DataFrame:
    """Profiles past warm-up whose rolling score is above the threshold, with event text."""
    scores = rolling_bypass_score(events, window)
    seen = distinct_sessions_per_profile(events).withColumnRenamed("n_sessions", "observed")
    joined = scores.join(seen, "profile_id")
    bad = (F.col("observed") > warmup) & (F.col("score") > threshold)
    return joined.where(bad).select(
        "profile_id", "score", "observed", F.lit("quarantined").alias("status"),
        F.format_string(f"rolling score %.3f > threshold {threshold}", "score").alias("detail"))
