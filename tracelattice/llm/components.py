"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, reread


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's smallest node.

    Each round hangs every node on the smallest neighbour it knows, so the number
    of rounds follows the logarithm of the longest path.  Self-links, repeated and
    null edges are ignored; an empty table gives an empty result.  Minima are
    combined before the shuffle and written out, which leaves plain joins that
    adaptive execution can split at a hub.
    """
    a, b = F.col(left), F.col(right)
    now = reread(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _state(now)
    while state[0]:
        # large star: larger neighbours of u hang on u's smallest neighbour (or u)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = checkpoint(large.distinct())
        # small star: smaller neighbours of u, and u, hang on the smallest of them
        least = checkpoint(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        now = checkpoint(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
