"""Near duplicates by SimHash: segment popcounts, a grid range join, exact verification.

A fingerprint of 64 bits is cut into 32 segments of two bits.  The vector of the
segments' bit counts is an embedding whose Manhattan distance never exceeds the
Hamming distance of two fingerprints.  In thermometer code (0: 00, 1: 01, 2: 11)
that distance is the popcount of an XOR.

Grid: each half of the vector (16 counts) is a cell.  If two fingerprints differ
in at most three bits, their distance in one half is at most one, so one of them
lies in the other's cell of that half or in a cell next to it.  Fingerprints are
posted in their two cells and probe the cells one step *above*; a step below is
found from the other side.  Inside a cell, the full lower bound and then the exact
distance are tested in blocks; each block passes on a spanning forest of its
links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .base import checkpoint, packed, release, unpacked
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Fingerprints of one side of a block.
BLOCK = 1024
_PAIRS = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles, unsigned; zero where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, digest = ends - lengths, xxhash.xxh64_intdigest
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hash of the text, fp long): a row for each row of ``docs``."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(_fingerprints, "doc_id long, hash long, fp long")


def _thermometer(x):
    up = F.shiftrightunsigned(x, 1)
    low, high = x.bitwiseOR(up).bitwiseAND(F.lit(_PAIRS)), x.bitwiseAND(up).bitwiseAND(F.lit(_PAIRS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def thermometer(x: np.ndarray) -> np.ndarray:
    mask, one = np.uint64(_PAIRS), np.uint64(1)
    return ((x | (x >> one)) & mask) | (((x & (x >> one)) & mask) << one)


def _cells(prints: DataFrame) -> DataFrame:
    """(cell, home, fp): home marks the fingerprint's own cell, otherwise it is one step below."""
    t = _thermometer(F.col("fp"))
    halves = prints.select("fp", F.explode(F.array(t.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(t, 32) + F.lit(1 << 32))).alias("cell"))
    steps = []
    for i in range(16):
        one, two = F.lit(1 << 2 * i), F.lit(3 << 2 * i)
        has = F.col("cell").bitwiseAND(two)
        steps.append(F.when(has == 0, F.col("cell") + one).when(has == one, F.col("cell") + F.lit(2 << 2 * i)))
    near = F.concat(F.array(F.struct(F.col("cell").alias("cell"), F.lit(True).alias("home"))), F.transform(F.array_compact(F.array(*steps)), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home"))))
    return halves.select("fp", F.explode(near).alias("x")).select("x.cell", "x.home", "fp")


def _forest(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sides of a block: node, its smaller root."""
    lt, rt = thermometer(left), thermometer(right)
    near = np.bitwise_count(lt[:, None] ^ rt[None, :]) <= distance
    i, j = np.nonzero(near)
    keep = np.bitwise_count(left[i] ^ right[j]) <= distance
    i, j = i[keep], j[keep]
    if not len(i):
        return left[:0], left[:0]
    nodes, ends = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    root = np.arange(len(nodes))
    while True:  # smallest label over links, then pointer jumping
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _linked(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            out_a, out_b = [], []
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(rows)].tolist()):
                side, fps = rows[lo:hi, 3], rows[lo:hi, 4].view(np.uint64)
                a, b = _forest(fps[side != 1], fps[side != 0], distance)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            held.append(rows)
            if (rows[0, :3] == rows[-1, :3]).all():
                continue  # a block may go on in the next batch
            rows = np.concatenate(held)
            last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))[-1]) + 1
            yield from links(rows[:last])
            held = [rows[last:]]
        if held:
            yield from links(np.concatenate(held))

    return run


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of distinct fingerprints within ``distance``.

    The grid's guarantee holds for distances up to three.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid finds distances from 0 to 3")
    cells = checkpoint(_cells(prints))
    sizes = cells.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("n0"), F.count("*").alias("n")).where("n0 > 0 and n > 1")
    sizes = checkpoint(sizes)
    live = cells.join(sizes, "cell")
    # sides: 0 left, 1 right, 2 both; a cell within one block is a single group
    g0, g1 = F.ceil(F.col("n0") / block), F.ceil(F.col("n") / block)
    i, j = F.pmod(F.xxhash64("fp"), g0), F.pmod(F.xxhash64("fp", F.lit(1)), g1)
    place = lambda x, y, side: F.struct(x.cast("long").alias("i"), y.cast("long").alias("j"), side.cast("long").alias("side"))
    single = F.array(place(F.lit(0), F.lit(0), F.when(F.col("home"), F.lit(2)).otherwise(F.lit(1))))
    left = F.when(F.col("home"), F.transform(F.sequence(F.lit(0).cast("long"), g1 - 1), lambda y: place(i, y, F.lit(0)))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,side:bigint>>"))
    right = F.transform(F.sequence(F.lit(0).cast("long"), g0 - 1), lambda x: place(x, j, F.lit(1)))
    blocks = live.select("cell", "fp", F.explode(F.when((g0 == 1) & (g1 == 1), single).otherwise(F.concat(left, right))).alias("p"))
    blocks = blocks.select("cell", "p.i", "p.j", "p.side", "fp").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return blocks.mapInArrow(_linked(distance), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, hash, fp, component_id): ``component_id`` is the smallest doc_id reachable over links.

    A row for each row of ``docs``.  Null and empty texts have fingerprint zero and
    link like others.  Rows without a doc_id keep their fingerprint; their
    component is the smallest doc_id among the documents they reach, null if none
    has one.  Other columns of ``docs`` are ignored.
    """
    prints = checkpoint(fingerprints(docs))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpoint(connected_components(links(distinct.select("fp"), distance), "a", "b"))
    members = checkpoint(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = checkpoint(members.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = checkpoint(members.join(least, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "hash", "fp", "component_id")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column(2)]
        sets = [jaccard.shingles(t) for t in texts]
        nodes, sizes = pa.array(map(jaccard.node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64())
        prints = np.array([fingerprint(t, jaccard.SHINGLE) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, pa.array(prints), sizes, pa.array(map(jaccard.sketch, sets), pa.binary())], ["doc", "hash", "node", "fp", "size", "sketch"])


def fingerprint_candidates(own: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links of (node, fp) rows, from each node to the smallest of its own fingerprint and between those of near fingerprints."""
    least = checkpoint(own.groupBy("fp").agg(F.min("node").alias("least")))
    same = own.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = links(least.select("fp"), distance)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("la")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("lb")), "b")
    return same.unionByName(near.select(F.col("la").alias("a"), F.col("lb").alias("b")))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest doc_id.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of
    0.8 or more, computed exactly; a group is what links reach.  Candidates are the
    links of SimHash fingerprints over the same shingles and, as these miss texts of
    0.8 that differ in more bits, the shared prefixes of ``jaccard``; in the end all texts
    that share a prefix shingle are compared unless their group is one already.  Of texts with
    the smallest doc_id the one with the smallest hash stays.  Null and empty texts
    are copies of each other.  Rows without a doc_id stay; rows with equal doc_id and
    text count as one document.
    """
    text = F.col("text").cast("string")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    named = rows.mapInArrow(_named, "doc long, hash long, node long, fp long, size long, sketch binary")
    own = checkpoint(named.groupBy("node").agg(F.min(F.struct("doc", "hash", "fp", "size", "sketch")).alias("x")).select("node", "x.doc", "x.hash", "x.fp", "x.size", "x.sketch"))
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    shared = jaccard.near_prints(jaccard.prefix_candidates(rows).select(high, low, "size"), own)
    pairs = checkpoint(shared.unionByName(fingerprint_candidates(own.select("node", "fp"), distance).select(high, low)).distinct())
    del named, shared
    release(docs.sparkSession)
    found = checkpoint(jaccard.similar(rows, own.select("node", "doc", "hash"), pairs))
    release(docs.sparkSession)
    roots = checkpoint(connected_components(found, "a", "b"))
    release(docs.sparkSession)  # the rounds fill the driver's heap with plans
    # all sets that may be similar and that these links leave apart
    more = checkpoint(jaccard.crossing_links(rows, own.drop("fp"), roots))
    release(docs.sparkSession)
    if not more.isEmpty():
        roots = checkpoint(connected_components(found.unionByName(more), "a", "b"))
        release(docs.sparkSession)
    members = own.join(roots.hint("merge"), "node", "left").select("doc", "hash", F.coalesce("root", "node").alias("root"))
    keep = checkpoint(members.groupBy("root").agg(F.min(F.struct("doc", "hash")).alias("k")).select(F.col("k.doc").alias("kept"), F.col("k.hash").alias("kept_hash")))
    rows = packed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(text))
    rows = rows.join(keep.hint("merge"), (rows["id"] == keep["kept"]) & (rows["hash"] == keep["kept_hash"]), "left").where(F.col("kept").isNotNull() | F.col("id").isNull())
    return rows.select(*unpacked(rows, docs.columns))


def op9(spark, sf_dir: str) -> DataFrame:
    from .base import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
