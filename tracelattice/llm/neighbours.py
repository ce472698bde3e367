"""Approximate nearest neighbours by inner product: a permutation index.

A vector is represented by its nearest pivots in order.  It is posted in the
inverted files of the first of them; a query opens the files of its own nearest
pivots, ranks what is posted there by Spearman's footrule between the two orders,
and reranks the best by exact inner products in double precision.  Long files are
cut into blocks, so that no task holds an unbounded one; every row is posted, and
each block answers for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpoint, grouped, table

#: Neighbours returned; every so many-th vec_id is a query.
TOP, EVERY = 20, 20
#: Rows that pivots are drawn from, and the number of pivots.
SAMPLE, PIVOTS = 8192, 128
#: Pivots in a vector's order; files that a row is posted in; files that a query opens.
ORDER, POSTED, OPENED = 48, 8, 24
#: Rows of a block that are reranked for a query: so many at least, and this share of the block.
RERANKED, RERANKED_SHARE = 400, 0.5
#: Rows of a block, on average.
BLOCK = 4096


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    near = x @ pivots.T
    length = min(length, near.shape[1])
    first = np.argpartition(-near, length - 1, axis=1)[:, :length]
    rank = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
    return np.take_along_axis(first, rank, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part.

    Left out: null ids; null, empty or zero vectors; vectors with null, NaN or
    infinite components; vectors of another length than most have (of equally
    common lengths the larger).  Of rows that repeat a vec_id, the smallest vector counts.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = checkpoint(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` distinct unit vectors of a bounded sample, chosen by the hash of vec_id."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    unique = np.unique(np.array([r["v"] for r in drawn], float), axis=0) if drawn else np.empty((0, 0))
    np.random.default_rng(7).shuffle(unique)
    unique = unique[:n]
    # by the largest component first: squares of large numbers must not overflow
    unique = unique / np.abs(unique).max(axis=1, keepdims=True) if len(unique) else unique
    return unique / np.linalg.norm(unique, axis=1, keepdims=True) if len(unique) else unique


def _posted(pivots: np.ndarray, queries: bool):
    width = min(OPENED if queries else POSTED, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            orders = _orders(x, pivots, ORDER)
            n = len(x)
            take = np.repeat(np.arange(n), width)
            order = pa.array([o.tobytes() for o in orders.astype(np.int16)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(orders[:, :width].ravel().astype(np.int32)), batch.column(0).take(pa.array(take)), order.take(pa.array(take)), batch.column(1).take(pa.array(take))], ["pivot", "id", "pivots", "v"])

    return run


def _order_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1).astype(np.int64)


def _searched(top: int, n_pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 2):
            side = group.column("side").to_numpy()
            rows, asked = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
            if not rows.num_rows or not asked.num_rows:
                continue
            ids = rows.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")  # ties of the footrule go to smaller ids
            rows, ids = rows.take(pa.array(order)), ids[order]
            x, q = _matrix(rows.column("v")), _matrix(asked.column("v"))
            orders, wanted = _order_matrix(rows.column("pivots")), _order_matrix(asked.column("pivots"))
            reranked = max(RERANKED, int(RERANKED_SHARE * len(ids)))
            length = orders.shape[1]
            place = np.full((len(ids), n_pivots), length, np.int8)
            np.put_along_axis(place, orders, np.arange(length, dtype=np.int8)[None, :], 1)
            place = np.ascontiguousarray(place.T)
            whole = length * (length + 1) // 2
            own = np.arange(length, dtype=np.int8)[:, None]
            found_q, found_id, found_score = [], [], []
            for k, query in enumerate(asked.column("id").to_numpy().tolist()):
                shared = place[wanted[k]]
                footrule = whole + (np.abs(shared - own) - (length - shared)).sum(0, dtype=np.int32)
                keep = ids != query
                if len(ids) > reranked:
                    best = np.argpartition(footrule.astype(np.int64) * len(ids) + np.arange(len(ids)), reranked)[: reranked + 1]
                    best = best[keep[best]]
                else:
                    best = np.flatnonzero(keep)
                score = x[best] @ q[k]
                first = np.lexsort((ids[best], -score))[:top]
                found_q.append(np.full(len(first), query))
                found_id.append(ids[best][first])
                found_score.append(score[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found_q, found_id, found_score)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each query, nearest first.

    Queries are the usable rows whose vec_id ``every`` divides; candidates are all
    usable rows but the query's own; ties go to the smaller vec_id.  An empty table,
    or one without usable rows, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    pivots = choose_pivots(rows, PIVOTS)
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = rows.schema["v"].dataType.simpleString()
    schema = f"pivot int, id long, pivots binary, v {kind}"
    posts = rows.mapInArrow(_posted(pivots, False), schema)
    sizes = {r["pivot"]: r["count"] for r in posts.groupBy("pivot").count().collect()}  # a row for each pivot
    cuts = F.element_at(F.lit([max(1, -(-sizes.get(p, 0) // BLOCK)) for p in range(len(pivots))]), F.col("pivot") + 1)
    left = posts.select("pivot", F.pmod(F.xxhash64("id"), cuts).cast("int").alias("block"), F.lit(0).alias("side"), "id", "pivots", "v")
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(_posted(pivots, True), schema)
    right = asked.select("pivot", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("block"), F.lit(1).alias("side"), "id", "pivots", "v")
    both = left.unionByName(right).repartition("pivot", "block").sortWithinPartitions("pivot", "block")
    found = both.mapInArrow(_searched(top, len(pivots)), "query_id long, vec_id long, score double")
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
