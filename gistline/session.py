"""Session settings and the two size-aware helpers every job shares."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Of equal keys of a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# A table is broadcast only after its rows and its bytes were measured below these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Below this much input per core a scan is spread before text work.
SPREAD_BYTES = 16 * 1024 * 1024
# Copies of each lookup row, and so the number of tasks a hot key is spread over.
SALTS = 64


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        # The driver serves this file to executors as long as the application runs.
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gistline-code-")), "gistline")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` is used as it stands. Only a local session without one gets
    a temporary folder; on a cluster that would be lost with the machine, so it is refused.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gistline-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts lineage as a reliable checkpoint does, but the plan runs once and later reads
    take only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


checkpoint = stored


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan over all cores.

    A parquet file of one row group is one task, however many cores wait, and text work is
    bound by the CPU. A scan of some size has tasks enough and is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup table. Two numbers reach the driver."""
    n, b = df.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    ).first()
    return n <= rows and b <= size


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "left",
           salts: int = SALTS, measure: bool = True) -> DataFrame:
    """Join a large table to a table with one row per key, whatever the key skew.

    A small lookup is broadcast once its size is measured. A large one is joined by
    shuffle; each of its rows is copied ``salts`` times and the rows of the large side pick
    a copy by their own content, so one hot key is spread over ``salts`` tasks. A lookup table
    that is itself computed from a large table should be ``stored`` before, as it is read twice.
    """
    if measure and fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    # A random salt could differ when a lost task runs again; a hash of the row cannot.
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if _hashable(big, c)]), F.lit(salts).cast("bigint"))
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    salted = small.withColumn("_salt", F.explode(copies))
    return big.withColumn("_salt", spread).join(salted, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def local_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A handful of driver rows as a local relation, which plans fold instead of scanning."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)
