"""The streams. Each takes a streaming DataFrame and starts a query.

Sums are streaming aggregations, which combine inside each task before the shuffle. What needs the order of
rows keeps Spark's own keyed state (``transformWithState`` over RocksDB): a few values per key, which event-time timers
end, so the state follows the keys that are alive and not all there ever were. A restart goes on from
the checkpoint. Results are Parquet, one folder per micro-batch; a batch that runs again replaces its own.

Rows of a key must not arrive in an earlier batch than rows they follow, where a job does not say otherwise; inside a
batch their order is free. Rows later than the watermark are dropped. A key's rows of one micro-batch are read by one
task, so the trigger's limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bound what it sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from gistline.functions import metrics as M
from gistline.operators import bypass as B
from gistline.operators.learn import FAST_LOCK_IN, LOCK_IN, SAMPLE_CAP
from gistline.plans.reduce import RuleTable, reduce_sessions
from gistline.session import ship
from gistline.streaming.state import BypassScores, DedupAdjacent, LockIn, NearDuplicates

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Keys of a state that many fingerprints or slots share; rows, and their bytes, that a task packs by them at a time.
BUCKETS = 4096
PACK_ROWS, PACK_BYTES = 500_000, 64 * 1024 * 1024
# Length of a slot of near duplicates, as a multiple of the reach: so many rows come once, and one more twice.
SLOTS = 8


def _run(stream: DataFrame, mode: str, handle, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _append(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch; a batch that runs again replaces its own."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _write(stream: DataFrame, mode: str, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return _run(stream, mode, lambda batch, batch_id: _append(batch, path, batch_id), checkpoint, trigger)


def _keyed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "Append",
           time: str = "EventTime") -> DataFrame:
    spark = ship(stream.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


def _packed(rows: DataFrame, key: str, size: int = PACK_ROWS, latest: str | None = None) -> DataFrame:
    """One row per key of every ``size`` rows or so of a task, the other columns as one Arrow record batch in ``rows``: rows reach
    a Python state value by value, which costs far more than the work on them. ``key`` is a number without nulls, and so is
    ``latest``, a column whose greatest value stands beside the batch. ``state.unpacked`` reads a batch, by ``_inner``."""
    names = [c for c in rows.columns if c != key]
    kind, inner = rows.schema[key].dataType.simpleString(), _inner(rows, key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size_in_bytes = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            size_in_bytes += batch.nbytes
            if n >= size or size_in_bytes >= PACK_BYTES:
                yield by_key(held)
                held, n, size_in_bytes = [], 0, 0
        if n:
            yield by_key(held)

    def by_key(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, table = keys[order], table.select(names).cast(inner).take(order).combine_chunks()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        (whole,) = table.to_batches()
        parts = [whole.slice(s, e - s).serialize().to_pybytes() for s, e in zip(starts, [*starts[1:], len(keys)], strict=True)]
        arrays, columns = [pa.array(keys[starts]), pa.array(parts, pa.binary())], [key, "rows"]
        if latest:
            arrays.append(pa.array(np.maximum.reduceat(table.column(latest).to_numpy(), starts)))
            columns.append("latest")
        return pa.RecordBatch.from_arrays(arrays, columns)

    return rows.mapInArrow(pack, f"`{key}` {kind}, rows binary" + (", latest long" if latest else ""))


def _inner(rows: DataFrame, key: str) -> pa.Schema:
    return to_arrow_schema(rows.drop(key).schema)


def _unlisted(rows: DataFrame) -> DataFrame:
    """Columns of equally long lists as rows."""
    return rows.select(F.inline(F.arrays_zip(*rows.columns)))


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key of a stream that writes updates."""
    rows = spark.read.parquet(path)
    values = F.struct(*[c for c in rows.columns if c not in (*keys, "batch_id")])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch_id").alias("r")).select(*keys, "r.*")


def stream_gain_daily(sessions: DataFrame, path: str, checkpoint: str, delay: str = "1 day",
                      trigger: dict | None = None) -> StreamingQuery:
    """Daily savings, an update of each day that changed; rows later than the watermark are dropped and its days
    closed. ``newest(spark, path, ["date"])`` reads them."""
    saved = M.tokens_saved(F.col("raw_bytes"), F.col("compressed_bytes"))
    days = sessions.withColumn("ts", F.timestamp_seconds("started_at")).withWatermark("ts", delay).groupBy(
        F.window("ts", "1 day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("compressed_bytes").alias("compressed_bytes"), F.sum(saved).alias("tokens_saved"))
    days = days.withColumn("date", M.utc_date(F.unix_seconds("window.start")).cast("string")).drop("window")
    return _write(days, "update", path, checkpoint, trigger)


def stream_reduce(sessions: DataFrame, table: RuleTable, path: str, checkpoint: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Reduce outputs as they arrive: a row is a whole session, so the batch job applies."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _append(reduce_sessions(batch, table), path, batch_id)

    return _run(sessions, "append", handle, checkpoint, trigger)


def stream_near_duplicate(runs: DataFrame, path: str, checkpoint: str, seconds: int = B.NEAR_SECONDS, delay: str = "1 hour",
                          trigger: dict | None = None) -> StreamingQuery:
    """(run_id, near_duplicate) of each run when it arrives, and once more when a late run turns it into one.

    Runs of an agent may come in any order inside the watermark ``delay``; what can no longer be within ``seconds`` of a
    run to come leaves the state. Runs without a time are dropped. ``near_duplicates`` reads the verdicts.
    """
    # Slots of time spread the runs of an agent; a run that can reach into the next slot stands there too.
    width = max(SLOTS * seconds, 60)
    own = F.floor(F.col("started_at") / width)
    ahead = F.floor((F.col("started_at") + seconds) / width)
    timed = runs.where("started_at is not null").select(
        "agent", "fingerprint", F.explode(F.sequence(own, ahead)).alias("slot"), "started_at", "run_id", own.alias("own"))
    timed = timed.withColumn("own", F.col("own") == F.col("slot")).withColumn(
        "bucket", F.pmod(F.xxhash64("agent", "fingerprint", "slot"), F.lit(BUCKETS)))
    # A batch is as late as its latest run, so the watermark is that of the runs; of a batch that is not late the state drops late runs.
    batches = _packed(timed, "bucket", latest="started_at").withColumn("ts", F.timestamp_seconds("latest")).withWatermark("ts", delay)
    found = _keyed(batches, ["bucket"], NearDuplicates(seconds, width, _inner(timed, "bucket")),
                   "run_id array<long>, near_duplicate array<boolean>")
    return _write(_unlisted(found), "append", path, checkpoint, trigger)


def near_duplicates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("run_id").agg(F.bool_or("near_duplicate").alias("near_duplicate"))


def stream_lock_in(samples: DataFrame, path: str, checkpoint: str, n: int = LOCK_IN, fast: int = FAST_LOCK_IN, cap: int = SAMPLE_CAP,
                   trigger: dict | None = None) -> StreamingQuery:
    """(fingerprint, n_samples, reason) once for each fingerprint, at the sample that locks it.

    Samples count in the order (captured_at, sample_id): the first ``fast`` ones lock if they are equal, else the
    ``n``-th does. State is a list of at most ``cap`` hashes, and after the verdict a flag; samples beyond are ignored.
    Fingerprints share ``BUCKETS`` keys of the state, a number that stays as long as the checkpoint.
    """
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS))
    rows = samples.select(
        bucket.alias("bucket"), "fingerprint", "captured_at", "sample_id", F.unhex(M.content_hash(F.col("text"))).alias("sha"))
    locked = _keyed(_packed(rows, "bucket"), ["bucket"], LockIn(n, fast, cap, _inner(rows, "bucket")),
                    "fingerprint array<string>, n_samples array<long>, reason array<string>", time="None")
    return _write(_unlisted(locked), "append", path, checkpoint, trigger)


def stream_bypass_score(events: DataFrame, path: str, checkpoint: str, window: int = B.WINDOW_RUNS, warmup: int = B.WARMUP_RUNS,
                        keep: int = 7 * 86_400, delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """(profile_id, score, n_sessions, observed): the mean capped weight of the newest ``window`` sessions of each profile,
    an update whenever it has events, from the session after ``warmup`` on.

    A session counts with its whole weight for as long as it is in the window or had events within ``keep`` seconds of
    the watermark; then it leaves the state. ``newest(spark, path, ["profile_id"])`` reads the scores.
    """
    rows = events.where("session_id is not null").select(
        "profile_id", "session_id", "at", F.when(F.col("kind") == "bypass_signal", F.col("weight")).alias("weight"),
        F.timestamp_seconds("at").alias("ts")).withWatermark("ts", delay)
    schema = "profile_id long, score double, n_sessions long, observed long"
    scores = _keyed(rows, ["profile_id"], BypassScores(window, warmup, keep), schema, "Update")
    return _write(scores, "update", path, checkpoint, trigger)


def stream_dedup_adjacent(lines: DataFrame, path: str, checkpoint: str, at: str = "at", idle: int = 86_400, delay: str = "1 hour",
                          trigger: dict | None = None) -> StreamingQuery:
    """Drop repeats line by line. The last line of a session is its state, until the watermark passes its last
    timestamp ``at`` by ``idle`` seconds; a line after that starts anew."""
    columns = ["session_id", "line_no", "sub_no", "text", "is_placeholder"]
    rows = lines.select(*columns, F.col(at).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.select(columns).schema)
    return _write(_keyed(rows, ["session_id"], DedupAdjacent(idle), schema), "append", path, checkpoint, trigger)
