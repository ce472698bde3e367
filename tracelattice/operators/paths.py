"""Paths from hop observations, and edges with nodes for silent hops.

An unknown node is the pair (anchor, depth): the depth-th silent hop behind the
known node ``anchor``.  It is the same node in every path, so no sequential memory
is needed; numbers are given at the end only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import dense_index

GAP_MODES = {"reference": 2, "full": 1}


def _skipped(ttl: Column, before: Column, gap_mode: str) -> Column:
    """Unknown nodes between two hops: the gap less one, or the whole gap in mode ``full``."""
    return F.greatest(ttl.cast("long") - before.cast("long") - GAP_MODES[gap_mode], F.lit(0).cast("long"))


def steps(hops: DataFrame, path: list[str], order: list[str], source: Column, gap_mode: str = "reference") -> DataFrame:
    """(anchor, hop, k): each hop with the node before it and the unknown nodes between.

    ``source`` stands before the first hop at TTL 0.
    """
    w = Window.partitionBy(*path).orderBy(*order)
    first = F.row_number().over(w) == 1
    before, ttl = F.when(first, source).otherwise(F.lag("hop").over(w)), F.coalesce(F.lag("ttl").over(w), F.lit(0))
    return hops.select(before.alias("anchor"), "hop", _skipped(F.col("ttl"), ttl, gap_mode).alias("k"))


def expand(walked: DataFrame) -> DataFrame:
    """Edges with natural keys: from_anchor, from_depth, to_anchor, to_depth; depth 0 is the node itself."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k")))
    end = F.col("j") == F.col("k")
    return walked.select("anchor", "hop", "k", at.alias("j")).select(
        F.col("anchor").alias("from_anchor"), F.col("j").alias("from_depth"), F.when(end, F.col("hop")).otherwise(F.col("anchor")).alias("to_anchor"), F.when(end, F.lit(0).cast("long")).otherwise(F.col("j") + 1).alias("to_depth")
    )


def path_edges(hops: DataFrame, ties: list[str], source: int = 0, gap_mode: str = "reference") -> DataFrame:
    """Edges of paths (target, hop, ttl) by TTL, ties by ``ties``; duplicates and self-loops stay."""
    return expand(steps(hops, ["target"], ["ttl", *ties], F.lit(source).cast("long"), gap_mode))


def trace_edges(traces: DataFrame, gap_mode: str = "reference") -> DataFrame:
    """Edges of traces (trace_id, source, hops of pos, ttl, kind, node) in the order of the records, never sorted by TTL.

    Hops of other kinds than ipv4 and ipv6 are left out and so leave a gap.
    """
    hops = traces.select("trace_id", "source", F.explode("hops").alias("h")).where(F.col("h.kind").isin("ipv4", "ipv6"))
    hops = hops.select("trace_id", "source", F.col("h.pos").alias("pos"), F.col("h.ttl").alias("ttl"), F.col("h.node").alias("hop"))
    return expand(steps(hops, ["trace_id"], ["pos"], F.col("source"), gap_mode))


def unknown_nodes(walked: DataFrame) -> DataFrame:
    """(anchor, depth) of every unknown node."""
    most = walked.groupBy("anchor").agg(F.max("k").alias("k")).where("k > 0")
    return most.select("anchor", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("depth"))


def unknown_ids(walked: DataFrame) -> DataFrame:
    """(anchor, depth, node_id): -1, -2, ... in the order of anchor and depth."""
    numbered = dense_index(unknown_nodes(walked), ["anchor", "depth"], "n", 1)
    return numbered.select("anchor", "depth", (-F.col("n")).alias("node_id"))


def number_edges(edges: DataFrame, unknown: DataFrame) -> DataFrame:
    """(from, to) of natural keys; only unknown ends need the lookup."""
    out = edges
    for end in ("from", "to"):
        anchor, depth = f"{end}_anchor", f"{end}_depth"
        rest = [c for c in out.columns if c not in (anchor, depth)]
        known = out.where(F.col(depth) == 0).select(F.col(anchor).cast("long").alias(end), *rest)
        silent = out.where(F.col(depth) > 0).join(unknown.select(F.col("anchor").alias(anchor), F.col("depth").alias(depth), F.col("node_id").alias(end)), [anchor, depth])
        out = known.unionByName(silent.select(F.col(end).cast("long").alias(end), *rest))
    return out.select("from", "to")


def max_node_ids(mapping: DataFrame, walked: DataFrame) -> DataFrame:
    """One row (known, unknown): the largest known id (0 without nodes) and the number of unknown nodes."""
    zero = F.lit(0).cast("long")
    known = mapping.select(F.col("node_id").cast("long").alias("known"), zero.alias("unknown"))
    unknown = walked.groupBy("anchor").agg(F.max("k").alias("unknown")).select(zero.alias("known"), "unknown")
    return known.unionByName(unknown).agg(F.coalesce(F.max("known"), zero).alias("known"), F.coalesce(F.sum("unknown"), zero).alias("unknown"))


def assembled(hops: DataFrame, ties: list[str]) -> DataFrame:
    """(target, path): the hops of a target by TTL, ties by ``ties``."""
    place = F.struct("ttl", *[t for t in ties if t != "hop"], "hop")
    return hops.groupBy("target").agg(F.array_sort(F.collect_list(place)).alias("p")).select("target", F.transform("p", lambda x: x["hop"]).alias("path"))
