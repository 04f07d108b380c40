"""Session tables: reading captured outputs, writing the fact table, sealing raw text."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistline import schema
from gistline.functions import metrics as M
from gistline.functions.fingerprint import fingerprint
from gistline.functions.redaction import redact_text
from gistline.functions.text import TAG
from gistline.operators.account import DAY, RETENTION_DAYS, purge_expired
from gistline.session import lookup, stored


def read_sessions(spark: SparkSession, path: str, source: str = "parquet", streaming: bool = False) -> DataFrame:
    """Captured outputs as parquet, JSON lines, or text files (one file is one output; an empty one gives no row)."""
    if source == "text":
        reader = spark.readStream if streaming else spark.read
        files = reader.format("text").option("wholetext", "true").load(path)
        return files.select(F.col("_metadata.file_path").alias("session_id"), F.col("value").alias("text"))
    reader = (spark.readStream if streaming else spark.read).schema(schema.SESSIONS_RAW)
    return reader.format(source).load(path).withColumn("text", F.coalesce("text", F.lit("")))


def with_commands(outputs: DataFrame, commands: DataFrame) -> DataFrame:
    """Captured text files (session_id, text) with what ran: ``commands`` has one row per file, (file, argv, agent, started_at,
    ended_at, exit_code), ``file`` being the last part of its path. All columns of a session; outputs without a
    command keep nulls, and so have no fingerprint and no rule set."""
    named = outputs.withColumn("file", F.element_at(F.split("session_id", "/"), -1))
    known = commands.select("file", "argv", "agent", "started_at", "ended_at", "exit_code")
    return lookup(named, known, ["file"]).select(
        "session_id", F.when(F.col("argv").isNotNull(), fingerprint(F.col("argv"))).alias("fingerprint"), "argv", "agent", "started_at",
        "ended_at", "exit_code", F.coalesce("text", F.lit("")).alias("text"))


def session_mode(has_profile: Column, shadow: Column, degraded: Column | None = None) -> Column:
    mode = F.when(shadow, "Shadow").when(has_profile, "Full").otherwise("Passthrough")
    return mode if degraded is None else F.when(degraded & ~shadow, "Degraded").otherwise(mode)


def raw_facts(sessions: DataFrame) -> DataFrame:
    """raw_bytes and raw_sha in place of ``raw`` (the redacted text) and ``preserve_raw``: what is left to
    know of a raw text before it is joined to anything."""
    sha = F.when(F.col("preserve_raw"), M.content_hash(F.col("raw")))
    return sessions.withColumns({"raw_sha": sha, "raw_bytes": F.octet_length("raw").cast("bigint")}).drop("raw", "preserve_raw")


def session_facts(reduced: DataFrame) -> DataFrame:
    """Fact rows. ``reduced``: session_id, fingerprint, profile_id, started_at, exit_code,
    compressed, mode, and raw (redacted text) with preserve_raw, or the columns of ``raw_facts``."""
    if "raw" in reduced.columns:
        reduced = raw_facts(reduced)
    raw, cmp = F.col("raw_bytes"), F.octet_length("compressed").cast("bigint")
    return reduced.select(
        "session_id", "fingerprint", "profile_id", "started_at", "exit_code", "raw_sha",
        M.content_hash(F.col("compressed")).alias("compressed_sha"),
        raw, cmp.alias("compressed_bytes"),
        M.tokens_saved(raw, cmp).alias("tokens_saved"), "mode")


def write_sessions(facts: DataFrame, path: str) -> None:
    """Partitioned by start day; writing a day again replaces that day only."""
    day = M.utc_date(F.col("started_at"))
    facts.withColumn("start_date", day).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("start_date").parquet(path)


def purge_sessions(spark: SparkSession, path: str, now: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Take the rows older than ``days`` out of a table of ``write_sessions``; one row per content reference set free.

    Whole days go with their folders and one day, in which the limit falls, is written again; later days are
    neither read nor written, nor are rows without a time. Of the rows that go only the references are read, and written
    down before anything is removed.
    """
    limit = now - days * DAY
    edge = datetime.fromtimestamp(limit, UTC).date()
    kept, released = purge_expired(spark.read.parquet(path).where(F.col("start_date") <= F.lit(edge)), now, days)
    released, last = stored(released), stored(kept)
    write_sessions(last.drop("start_date"), path)
    left = {str(r.start_date) for r in last.select("start_date").distinct().collect()}  # the day of the limit or none
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name, _, day = status.getPath().getName().partition("=")
        if name == "start_date" and day <= str(edge) and day not in left:
            fs.delete(status.getPath(), True)
    return released


def attestation_line(profile: Column, version: Column, fidelity: Column, mode: Column,
                     session_id: Column, failed: Column | None = None, tag: str = TAG) -> Column:
    """Footer of an emitted text, and a second line when invariants failed."""
    line = F.concat(
        F.lit(f"[{tag}: profile "), F.coalesce(profile, F.lit("<none>")), F.lit("/v"),
        F.coalesce(version, F.lit("-")), F.lit(", fidelity "), F.format_string("%.2f", fidelity),
        F.lit(", mode="), mode, F.lit(f", raw via {tag} show "), session_id, F.lit("]"))
    if failed is None:
        return line
    second = F.concat(F.lit(f"\n[{tag}: invariants failed: "), F.array_join(failed, ", "), F.lit("]"))
    return F.when(F.size(failed) > 0, F.concat(line, second)).otherwise(line)


def redaction_policy(binary: Column, allow: list[str], deny: list[str]) -> Column:
    """On unless allowed; denied wins."""
    return ~binary.isin(*allow) | binary.isin(*deny)


def preserve_raw_policy(binary: Column, preserve: bool, deny: list[str], force: list[str]) -> Column:
    return binary.isin(*force) | (F.lit(preserve) & ~binary.isin(*deny))


def seal_raw(sessions: DataFrame, key: Column) -> DataFrame:
    """Encrypt the raw text: one version byte, the random IV, the ciphertext and its tag."""
    body = F.aes_encrypt(F.col("text").cast("binary"), key, F.lit("GCM"))
    return sessions.withColumn("sealed", F.concat(F.unhex(F.lit("01")), body)).drop("text")


def open_raw(sealed: DataFrame, key: Column, redacted: bool = True) -> DataFrame:
    """Decrypt; a sealed value that does not decrypt is an error. Redacted unless asked."""
    body = F.aes_decrypt(F.substring("sealed", 2, 2_147_483_647), key, F.lit("GCM")).cast("string")
    is_sealed = F.hex(F.substring("sealed", 1, 1)) == "01"
    text = F.when(is_sealed, body).otherwise(F.col("sealed").cast("string"))
    opened = sealed.withColumn("text", text).drop("sealed")
    return redact_text(opened) if redacted else opened


def record_access(session_ids: DataFrame, path: str, at: int) -> None:
    """Append who asked for unredacted text to the access log."""
    session_ids.select(F.lit(at).cast("bigint").alias("at"), "session_id",
                       F.lit("raw-unredacted").alias("access")).write.mode("append").parquet(path)
