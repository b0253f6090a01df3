"""Tables in the cluster's shared folder: they cut the lineage of loops and outlive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one named in spark.checkpoint.dir; it goes when the application ends.

    Where none is named, a single-process session takes a temporary folder, and a cluster is refused: no folder of one machine is shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    folder = f"{base.rstrip('/')}/govlens/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def together(*tables: DataFrame) -> DataFrame:
    """Several tables that ``table`` wrote with one schema, as one scan."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[t.scratch_path for t in tables])


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(text.encode())
    out.close()


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch paths through Hadoop's file system."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gone(*tables: DataFrame) -> None:
    """Deletes what ``table`` wrote, once nothing reads it any more."""
    for t in tables:
        drop(t.sparkSession, t.scratch_path)
