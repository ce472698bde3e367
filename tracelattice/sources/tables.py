"""Result tables as CSV with headers, and their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """A folder of CSV parts with headers, in the order of ``order`` over all parts."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges by header names; malformed rows are dropped."""
    return spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "DROPMALFORMED").schema(schemas.EDGES).csv(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary (ip text, node_id) of an earlier run."""
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(schemas.MAPPING).csv(path)


def read_degree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(schemas.DEGREE).csv(path)


def read_betweenness(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(schemas.BETWEENNESS).csv(path)


def read_max_node_ids(spark: SparkSession, path: str) -> tuple[int, int]:
    """(known, unknown) of the first row; an empty table is an error."""
    row = spark.read.option("header", "true").schema(schemas.MAX_NODE_IDS).csv(path).first()
    if row is None:
        raise ValueError(f"{path} has no row")
    return row["known"], row["unknown"]
