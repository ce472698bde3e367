"""Degree statistics in closed form.

With o and i the out- and in-degree and t their sum, the number of two-step walks
from a node is the sum of its successors' out-degrees, and the degrees at their ends
factor through the first step.  Two rounds over the edges replace the walks.  All
sums are whole numbers, so each statistic is one division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree_in, degree_out) of distinct edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from").alias("n"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("o")), F.struct(F.col("to").alias("n"), F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.n").alias("node_id")).agg(F.sum("e.i").alias("degree_in"), F.sum("e.o").alias("degree_out"))


def _sums(edges: DataFrame, values: DataFrame, out: dict[str, str], into: dict[str, str]) -> DataFrame:
    """For each node: sums of its successors' values (``out``: name to column) and of its predecessors' (``into``)."""
    zero = F.lit(0).cast("long")
    at_to = edges.join(values.withColumnRenamed("node_id", "to"), "to").select(F.col("from").alias("node_id"), *(F.col(c).alias(n) for n, c in out.items()), *(zero.alias(n) for n in into))
    at_from = edges.join(values.withColumnRenamed("node_id", "from"), "from").select(F.col("to").alias("node_id"), *(zero.alias(n) for n in out), *(F.col(c).alias(n) for n, c in into.items()))
    return at_to.unionByName(at_from).groupBy("node_id").agg(*(F.sum(n).alias(n) for n in (*out, *into)))


def degree_table(edges: DataFrame) -> DataFrame:
    """The nine columns of the degree statistics for every node of distinct ``edges``."""
    one = checkpoint(degrees(edges).withColumn("t", F.col("degree_in") + F.col("degree_out")))
    first = checkpoint(_sums(edges, one, {"so": "degree_out", "to_": "t"}, {"si": "degree_in", "ti": "t"}))
    second = _sums(edges, first, {"so2": "so", "to2": "to_"}, {"si2": "si", "ti2": "ti"})
    all_ = one.join(first, "node_id").join(second, "node_id")
    c = F.col
    return all_.select(
        "node_id", "degree_in", "degree_out",
        _ratio(c("si"), c("degree_in")).alias("and_in"),
        _ratio(c("so"), c("degree_out")).alias("and_out"),
        _ratio(c("to_") + c("ti"), c("t")).alias("and_total"),
        _ratio(c("si") + c("si2"), c("degree_in") + c("si")).alias("iand_in"),
        _ratio(c("so") + c("so2"), c("degree_out") + c("so")).alias("iand_out"),
        _ratio(c("to_") + c("ti") + c("to2") + c("ti2"), c("t") + c("so") + c("si")).alias("iand_total"),
    )
