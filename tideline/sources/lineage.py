"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own = ""


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset in local mode, a temporary folder of this machine; on a cluster that is an error."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own = _own or tempfile.mkdtemp(prefix="tideline-")
        folder = _own
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of this library's own that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def version(spark: SparkSession, path: str) -> int:
    """A number that changes with the names, sizes and times of the files of a table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, seen = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared folder as Parquet and read again: smaller than a checkpoint, and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint, which outlives executors.

    Files go with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
