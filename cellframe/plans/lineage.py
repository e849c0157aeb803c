"""Stored intermediates for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder, set as the context's too; where none is set, one of this machine if Spark runs in it alone."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and of known size, so that joins of the next round can be planned by it."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def renewed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` in the place of ``before``, the table that it was computed from."""
    found = stored(after)
    discard(before)
    return found
