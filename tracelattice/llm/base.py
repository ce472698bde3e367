"""What the operators share: tables, the shared folder, lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint, checkpoint_dir, filesystem, release, remove_folder, reread, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: pa.Array) -> Iterator[str | None]:
    """The strings of a column one by one, so that no second copy of a batch is made."""
    for value in column:
        yield value.as_py()


def string_column(df: DataFrame, name: str):
    """``name`` as a string column, or a null one where ``df`` has no such column."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def packed(df: DataFrame, **columns) -> DataFrame:
    """``columns`` and the whole row in a struct ``row``, so that no name of ``df`` can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, columns: list[str], **changed) -> list:
    """The columns of ``row`` under their own names, those in ``changed`` replaced."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in the first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        begin = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
