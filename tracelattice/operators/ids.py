"""Dense ids without a single-task numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint

_ROW_BITS = 33


def dense_index(df: DataFrame, order: list[str], name: str = "index", start: int = 0) -> DataFrame:
    """``df`` with ``name`` = start, start + 1, ... in the order of ``order``.

    Rows are dealt by range and sorted in their partitions; each partition's count
    shifts the next ones.  What reaches the driver is one number for each partition.
    """
    row = F.monotonically_increasing_id()
    numbered = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", row))
    part, place = F.shiftright("_row", _ROW_BITS), F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    shift, total = {}, start
    for p, n in counts:
        shift[p], total = total, total + n
    if not shift:
        return numbered.withColumn(name, F.lit(0).cast("long")).drop("_row")
    first = F.element_at(F.lit([shift.get(p, 0) for p in range(max(shift) + 1)]), (part + 1).cast("int"))
    return numbered.withColumn(name, first + place).drop("_row")


def node_mapping(hops: DataFrame, ordinal: list[str], first: int = 1) -> DataFrame:
    """(ip, node_id): ids in the order of first encounter, in each row the target before the hop.

    ``ordinal`` names the columns that order the rows of ``hops`` (target, hop).
    """
    seen = hops.select(F.explode(F.array(*(F.struct(F.col(c).alias("ip"), F.lit(k).alias("k")) for k, c in enumerate(("target", "hop"))))).alias("x"), *ordinal)
    place = F.struct(*ordinal, "x.k")
    met = seen.select("x.ip", place.alias("place")).where("ip is not null").groupBy("ip").agg(F.min("place").alias("place"))
    # dealing by range samples its input first
    return dense_index(checkpoint(met), ["place", "ip"], "node_id", first).select("ip", "node_id")


def encode_hops(hops: DataFrame, mapping: DataFrame) -> DataFrame:
    """``hops`` with target and hop replaced by their ids."""
    rest = [c for c in hops.columns if c not in ("target", "hop")]
    m = mapping.select("ip", "node_id")
    return (
        hops.join(m.select(F.col("ip").alias("target"), F.col("node_id").alias("target_id")), "target")
        .join(m.select(F.col("ip").alias("hop"), F.col("node_id").alias("hop_id")), "hop")
        .select(F.col("target_id").alias("target"), F.col("hop_id").alias("hop"), *rest)
    )
