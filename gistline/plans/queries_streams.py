"""Registered queries: each stream run over a driver table until it is read up. The SQL twin
is the one of the batch job, because both must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gistline.plans.queries_tables import REDUCED, ROUND, SCORES, rule_table
from gistline.plans.views import REGISTRY, twin, view
from gistline.session import shared_folder
from gistline.streaming import jobs as J

query = REGISTRY.add


BATCHES = 3


def run_in_batches(spark, sf_dir: str, name: str, order: str, start) -> str:
    """A derived view arriving in ``BATCHES`` parts by ``order``; the stream is started again for each.

    ``start(stream, base)`` starts the query with its state, output and checkpoint below ``base``.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    rows = view(spark, sf_dir, name)
    cuts = rows.agg(F.percentile_approx(order, [k / BATCHES for k in range(1, BATCHES)])).first()[0]
    part = sum((F.coalesce(F.col(order) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for k in range(BATCHES):
        rows.where(part == k).write.mode("append").parquet(f"{base}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), base).awaitTermination()
    return base


@query("stream_gain_daily", twin("ledger", """
select strftime(to_timestamp(started_at) at time zone 'UTC', '%Y-%m-%d') as date, count(*) as runs,
 cast(sum(raw_bytes) as bigint) as raw_bytes, cast(sum(compressed_bytes) as bigint) as compressed_bytes,
 cast(sum(greatest(raw_bytes - compressed_bytes, 0) // 4) as bigint) as tokens_saved from ledger group by 1"""))
def _(spark, d):
    base = run_in_batches(spark, d, "ledger", "started_at", lambda s, b: J.stream_gain_daily(s, f"{b}/out", f"{b}/checkpoint"))
    return J.newest(spark, f"{base}/out", ["date"])


@query("stream_reduce", twin("tools_clean", REDUCED + "select session_id, line_no, text, is_placeholder from reduced"))
def _(spark, d):
    rules = rule_table(spark)
    base = run_in_batches(spark, d, "tools", "doc_id", lambda s, b: J.stream_reduce(s, rules, f"{b}/out", f"{b}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select("session_id", "line_no", "text", "is_placeholder")


@query("stream_near_duplicate", twin("runs", """
select run_id, coalesce(started_at - lag(started_at) over (partition by agent, fingerprint
 order by started_at, run_id) <= 600, false) as near_duplicate from runs"""))
def _(spark, d):
    base = run_in_batches(spark, d, "runs", "started_at", lambda s, b: J.stream_near_duplicate(
        s, f"{b}/out", f"{b}/checkpoint", seconds=600))
    return J.near_duplicates(spark, f"{base}/out")


@query("stream_lock_in", twin("small_samples", """
, s as (select fingerprint, sha256(text) as sha, row_number() over (partition by fingerprint
  order by captured_at, sample_id, sha256(text)) as k from small_samples),
v as (select fingerprint, count(*) as n, count(distinct sha) filter (k <= 3) = 1 and count(*) >= 3 as fast from s group by 1)
select fingerprint, cast(case when fast then 3 else 5 end as bigint) as n_samples,
 case when fast then 'zero_variance_fast_path' else 'reached_n' end as reason from v where fast or n >= 5"""))
def _(spark, d):
    base = run_in_batches(spark, d, "small_samples", "sample_id", lambda s, b: J.stream_lock_in(s, f"{b}/out", f"{b}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select("fingerprint", "n_samples", "reason")


@query("stream_bypass_score", twin("bypass", SCORES + """, r as (select *, row_number() over (partition by profile_id
 order by latest desc, session_id) as rn from s)
select profile_id, round(sum(score) / count(*), 9) as score, count(*) as n_sessions from r where rn <= 100 group by profile_id
 having count(*) > 3"""))
def _(spark, d):
    base = run_in_batches(spark, d, "bypass", "at", lambda s, b: J.stream_bypass_score(s, f"{b}/out", f"{b}/checkpoint"))
    return J.newest(spark, f"{base}/out", ["profile_id"]).select("profile_id", F.round("score", ROUND).alias("score"), "n_sessions")


@query("stream_dedup_adjacent", twin("timed_lines", """
select session_id, line_no, text from (select *, lag(text) over (partition by session_id order by line_no) as p
from timed_lines) where p is null or p <> text"""))
def _(spark, d):
    # Users come back after days; here no session ends.
    base = run_in_batches(spark, d, "timed_lines", "line_no", lambda s, b: J.stream_dedup_adjacent(
        s.withColumn("at", F.timestamp_seconds("at")), f"{b}/out", f"{b}/checkpoint", idle=366 * 86_400, delay="366 days"))
    return spark.read.parquet(f"{base}/out").select("session_id", "line_no", "text")
