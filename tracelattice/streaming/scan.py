"""Scans that grow: files that arrive in a folder become hop rows as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import yarrp


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the text files of ``folder``, old and new; the place within a file is its name alone."""
    text = spark.readStream.option("lineSep", "\n").schema("value string").text(folder)
    return text.select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file_name"))


def stream_hops(spark: SparkSession, folder: str, output: str, checkpoint: str, family: str = "V4") -> StreamingQuery:
    """Appends the parsed rows of arriving files to a Parquet table and stops when all are read."""
    rows = yarrp.hops(stream_lines(spark, folder), family, "permissive")
    return rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
