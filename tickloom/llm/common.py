"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For Java's regular expressions.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of text that go to a Python worker at once, whatever the rows' length.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000
#: Sides of at most so many bytes, as counted from their rows, may be broadcast.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own where that is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tickloom-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text in UTF-8: what bytes.split() takes for white space, and no other spaces of Unicode."""
    return text.split()


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+, 0 for null; runs in the JVM."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    return (
        F.size(parts)
        - (F.element_at(parts, 1) == "").cast("int")
        - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    ).cast("long")


def map_arrow(df: DataFrame, function, schema, tidy: bool = True) -> DataFrame:
    """df.mapInArrow() with batches of bounded size, by rows and by bytes; the session keeps these settings, which are the
    same for all callers. tidy=False leaves a worker its memory, for rounds that need it again."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        if tidy:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that a Python worker no longer needs back to the system, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unused(columns: list[str], prefix: str) -> str:
    """A prefix that none of the columns has."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def small_enough(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted, stays under the bound of what may be broadcast."""
    return df.limit(bound // row_bytes + 1).count() <= bound // row_bytes


def delete(spark: SparkSession, path: str) -> None:
    """A folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
