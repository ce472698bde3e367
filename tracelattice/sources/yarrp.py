"""YARRP text scans: listing, lines, fields and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ip import checked_ipv4_number, ipv6_bytes, is_ipv4, is_ipv6
from ..plans.lineage import once

MODES = ("failfast", "permissive")
#: Order of rows within a scan.
ORDINAL = ["file_name", "block_start", "line_no"]


def _files(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.isFile())


def scan_files(spark: SparkSession, folder: str, compressed: bool) -> list[str]:
    """Regular files directly in ``folder``: names ending ``.bz2`` in compressed mode, all others in plain mode."""
    return [f for f in _files(spark, folder) if f.endswith(".bz2") == compressed]


def read_lines(spark: SparkSession, folder: str, compressed: bool = False) -> DataFrame:
    """The lines of a scan with their places; no files give an empty table.

    Lines end at a newline; one carriage return before it is dropped.
    """
    files = scan_files(spark, folder, compressed)
    if not files:
        return spark.createDataFrame([], schemas.LINES)
    text = spark.read.option("lineSep", "\n").schema("value string").text(files)
    return text.select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_no"))


def _checked(fields: Column, family: str) -> tuple[Column, Column]:
    """(ttl, reason): checks in the order shape, ttl, ip, family."""
    target, hop = F.get(fields, 0), F.get(fields, 6)
    count = F.get(fields, 5)
    ttl = F.when(count.rlike(r"^\+?[0-9]+$"), count.try_cast("decimal(38,0)"))
    ttl = F.when(ttl.between(0, 255), ttl.cast("int"))
    t4, h4, t6, h6 = is_ipv4(target), is_ipv4(hop), is_ipv6(target), is_ipv6(hop)
    # rows of the expected family need one test for each address
    fits = (t4 & h4) if family == "V4" else (t6 & h6)
    reason = F.when(F.size(fields) < 8, "shape").when(ttl.isNull(), "ttl").when(fits, F.lit(None)).when((t4 | t6) & (h4 | h6), "family").otherwise("ip")
    return ttl, reason


def parse(lines: DataFrame, family: str = "V4") -> DataFrame:
    """Every line that is no comment, with its texts, ttl and the reason to reject it (null: none).

    Fields are separated by single spaces: 0 is the target, 5 the hop count, 6 the
    hop, and a further one must follow.
    """
    if family not in ("V4", "V6"):
        raise ValueError("the family is V4 or V6")
    rows = once(once(lines, line=F.col("value")).where(~F.col("line").startswith("#")), fields=F.split("line", " "))
    ttl, reason = _checked(F.col("fields"), family)
    rows = once(rows, target_text=F.get("fields", 0), hop_text=F.get("fields", 6), ttl=ttl, reason=reason)
    return rows.select(*[c for c in lines.columns if c != "value"], "value", "target_text", "hop_text", "ttl", "reason")


def hops(lines: DataFrame, family: str = "V4", mode: str = "failfast") -> DataFrame:
    """(target, hop, ttl, place): parsed rows, addresses as LONG (V4) or 16 bytes (V6).

    ``failfast`` stops at a bad shape, hop count or family, and skips bad addresses;
    ``permissive`` skips every rejected row.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    rows = parse(lines, family)
    if mode == "failfast":
        stop = F.raise_error(F.concat(F.lit("bad scan row ("), F.col("reason"), F.lit("): "), F.col("value"))).cast("string")
        rows = rows.withColumn("reason", F.when(F.col("reason").isin("shape", "ttl", "family"), stop).otherwise(F.col("reason")))
    number = checked_ipv4_number if family == "V4" else ipv6_bytes
    places = [c for c in lines.columns if c != "value"]
    return rows.where("reason is null").select(number(F.col("target_text")).alias("target"), number(F.col("hop_text")).alias("hop"), "ttl", *places)


def rejects(lines: DataFrame, family: str = "V4") -> DataFrame:
    """(reason, rows) of a scan's rejected rows."""
    return parse(lines, family).where("reason is not null").groupBy("reason").agg(F.count("*").alias("rows"))
