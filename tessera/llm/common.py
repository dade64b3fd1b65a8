"""Shared plumbing: the cluster's shared folder, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its written size is at most this many bytes.
BROADCAST_BYTES = 16 << 20

TOKENIZERS = "/opt/tokenizers"

#: Whether shuffle files go when a query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches: ``spark.checkpoint.dir``; where unset, a temporary one in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write ``df`` as Parquet in the shared folder; return it reread, and its bytes on disk.

    The lineage ends at the files, so a lost executor costs no recomputation of what came before,
    and the shuffle files of the write are deleted at its end rather than when the driver
    collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), table_bytes(spark, path)


def table_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def small(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` hinted for broadcast if its written ``size`` allows; else as it is, and Spark shuffles."""
    return F.broadcast(df) if size <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the Arrow batches that go to Python, where the session has Spark's defaults.
#: Documents are kilobytes each, so Spark's 10,000 rows would be tens of megabytes a task, twice.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with small batches, and with the worker's free memory given back after each task."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(trimmed, schema)


def trim() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
