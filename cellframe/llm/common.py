"""What the training-data operators share: materialised intermediates and batch handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task holds at once.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, one of this machine if Spark runs in it alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, codec: str = "zstd", records: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``records`` bounds the rows of a file where rows are large.

    This cuts the lineage: a lost executor costs the tasks that it ran, never the rows computed here.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("maxRecordsPerFile", records).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote and that nothing reads any more."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def renewed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` in the place of ``before``, the table of a round that it was computed from."""
    stored = materialise(after)
    discard(before)
    return stored


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: what groups by it later needs no shuffle."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    writer.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as in no held-out part."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def text_slices(batch: pa.RecordBatch, column: int = 0, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts make up about ``limit`` bytes, at least a row each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as the empty text, with offsets of 64 bits so that no slice overflows them."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def let_go() -> None:
    """Gives memory that a task's batches took back to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, length), run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)
