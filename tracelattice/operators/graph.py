"""The graph: distinct edges, its reverse, its nodes and the range of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_edges(edges: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Each (from, to) once; with ``bounds`` (known, unknown) only sources within -unknown..known."""
    out = edges.select(F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to")).distinct()
    if bounds is None:
        return out
    return out.join(F.broadcast(bounds.limit(1)), F.col("from").between(-F.col("unknown"), F.col("known"))).select("from", "to")


def within(rows: DataFrame, known: int, unknown: int, node: str = "node_id") -> DataFrame:
    """The rows whose ``node`` lies within -unknown..known."""
    return rows.where(F.col(node).between(-unknown, known))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to").alias("from"), F.col("from").alias("to"))


def nodes(edges: DataFrame) -> DataFrame:
    """(node_id) of every end of an edge."""
    return edges.select(F.explode(F.array("from", "to")).alias("node_id")).distinct()


def sources(edges: DataFrame) -> DataFrame:
    """(node_id) of every node with a successor."""
    return edges.select(F.col("from").alias("node_id")).distinct()


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("from") == F.col("to"))
