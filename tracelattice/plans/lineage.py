"""Lineage cuts and intermediate tables, in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs in one process (tests), a local folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tracelattice-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system: the default one where it names none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{qualified(spark, checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_on_exit(spark: SparkSession, uri: str) -> None:
    """Has ``uri`` removed when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; works in tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner acts on what the driver's collector finds; the last references to a
    finished plan fall a moment after its job, so one collection is not enough.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed and reread from the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reread(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, until the driver's JVM ends.

    A checkpoint keeps the estimated size of its plan, which is a product over all joins before;
    over the rounds of several iterations it gets millions of digits.  A file's size is its own.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    remove_on_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def once(df: DataFrame, **columns) -> DataFrame:
    """``df`` and ``columns``, which are computed once a row: the optimizer doesn't copy them into what uses them."""
    from pyspark.sql import functions as F

    packed = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(packed)).alias("_once")).select(*df.columns, *(F.col("_once").getField(n).alias(n) for n in columns))
