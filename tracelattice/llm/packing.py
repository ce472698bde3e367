"""Best-fit packing of token sequences into bins of several permitted lengths.

Texts become token ids with an end mark, cut at the largest length.  Pieces are dealt
by hash into groups of bounded size that are packed alone.  Within a group, longest
pieces first, each goes to the open bin that it fills best; where it fits none, a bin
is opened whose length a policy gives for pieces like it.  The policy is chosen for
all lengths together: a descent over it, one class of pieces at a time, keeps the
change that lowers the cost of the whole packing most.  At last every bin shrinks to
the smallest permitted length that holds its contents, which the cost counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, grouped, table

#: Permitted lengths in tokens; the fixed cost of a sequence, in tokens.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 32
#: The model's width: in a layer, attention costs a token length / (6 * WIDTH) of the rest.
WIDTH = 2048
#: Most pieces that are packed together, on average.
GROUP = 8192


def bin_cost(size: int) -> float:
    """What a sequence of ``size`` tokens costs, in tokens of linear layers."""
    return size * (1 + size / (6 * WIDTH)) + OVERHEAD


def _filled(lengths: Sequence[int], order: Sequence[int], sizes: Sequence[int], policy: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset in it, contents of each bin) if an item of class k opens a bin of ``sizes[policy[k]]``."""
    rest = sum(lengths)
    room: list[int] = []  # distinct free room of open bins, ascending
    open_bins: dict[int, list[int]] = defaultdict(list)
    filled: list[int] = []
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, n)
        if at < len(room):
            free = room[at]
            b = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free], room[at]
        else:
            # no larger than what is left can fill
            free = sizes[min(policy[bisect_left(sizes, n)], bisect_left(sizes, min(rest, sizes[-1])))]
            b = len(filled)
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += n
        free -= n
        rest -= n
        if free not in open_bins:
            insort(room, free)
        open_bins[free].append(b)
    return where, offset, filled


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset in it, size of each bin); items must fit the largest size.

    Each item opens or joins a bin in the order of falling length, ties in the order
    given.  Items of length zero take no room and join the fullest open bin.  The cost
    is no higher than that of opening the largest size, or each item's own size, always.
    """
    sizes = sorted(set(capacities))
    if any(x > sizes[-1] for x in lengths):
        raise ValueError("an item is longer than the largest size")
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    present = sorted({bisect_left(sizes, n) for n in lengths})
    last = len(sizes) - 1
    known: dict[tuple, tuple] = {}

    def tried(policy: tuple) -> tuple:
        if policy not in known:
            where, offset, filled = _filled(lengths, order, sizes, policy)
            final = [sizes[bisect_left(sizes, used)] for used in filled]
            known[policy] = (sum(map(cost, final)), where, offset, final)
        return known[policy]

    best = min(((last,) * len(sizes), tuple(range(len(sizes)))), key=lambda p: tried(p)[0])
    while True:
        near = [(*best[:k], c, *best[k + 1 :]) for k in present for c in range(k, last + 1)]
        step = min([best, *near], key=lambda p: tried(p)[0])
        if tried(step)[0] >= tried(best)[0]:
            return tried(best)[1:]
        best = step


_PIECES = "doc_id long, piece long, start long, length long, data binary"
_BINS = "pack long, bin long, capacity long, used long, ids binary, documents array<struct<doc_id:bigint,piece:bigint,start:bigint,length:bigint,offset:bigint>>"
_PLACES = pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "offset")]))


def _tokenised(most: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shards import END, text_tokens

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), text_tokens(batch.column(1), path)):
                ids = np.append(ids.astype(np.uint16), np.uint16(END))
                rows += [(doc, k, s, min(most, len(ids) - s), squeeze.compress(ids[s : s + most].tobytes())) for k, s in enumerate(range(0, len(ids), most))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "data"])

    return run


def token_pieces(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, data): the token ids of each whole text and an end mark, cut at the largest length.

    Null and empty texts have the end mark alone.  ``data`` has two bytes for each
    token, low byte first, compressed.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_tokenised(max(capacities), path), _PIECES)


def _packed(capacities: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        most = 2 * max(capacities)
        for group in grouped(batches, 1):
            group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
            name = group.column("pack")[0].as_py()
            lengths = group.column("length").to_pylist()
            where, offset, final = pack(lengths, capacities)
            order = np.lexsort((np.arange(len(where)), offset, where))
            cuts = np.searchsorted(np.array(where)[order], np.arange(len(final) + 1))
            places = pa.StructArray.from_arrays([*(group.column(c).combine_chunks().take(pa.array(order)) for c in ("doc_id", "piece", "start", "length")), pa.array(np.array(offset, np.int64)[order])], ["doc_id", "piece", "start", "length", "offset"])
            data = group.column("data")
            for lo in range(0, len(final), 512):  # the sequences of a group are not in memory at once
                some = range(lo, min(lo + 512, len(final)))
                ids = [b"".join(b"" if (d := data[int(i)].as_py()) is None else expand.decompress(d, max_output_size=most) for i in order[cuts[b] : cuts[b + 1]]) for b in some]
                used = [sum(lengths[i] for i in order[cuts[b] : cuts[b + 1]]) for b in some]
                first, end = int(cuts[some[0]]), int(cuts[some[-1] + 1])
                documents = pa.ListArray.from_arrays(pa.array((cuts[lo : some[-1] + 2] - first).astype(np.int32)), places.slice(first, end - first)).cast(_PLACES)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), pa.array(list(some), pa.int64()), pa.array([final[b] for b in some], pa.int64()), pa.array(used, pa.int64()), pa.array(ids, pa.binary()), documents], ["pack", "bin", "capacity", "used", "ids", "documents"])

    return run


def pack_pieces(pieces: DataFrame, capacities: Sequence[int] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """A row for each bin of the rows of ``token_pieces``, which are computed once.

    Columns: pack and bin (which name the bin together), capacity (its final length),
    used, ids (the packed sequence, two bytes a token; the rest up to capacity is for
    the trainer to fill), documents (doc_id, piece, start, length of what is in it and
    the offset in the bin).
    """
    pieces = checkpoint(pieces)
    groups = max(1, -(-pieces.count() // group))
    # by row, not by doc_id: a doc_id may repeat without bound; the checkpoint keeps the rows' numbers
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    dealt = dealt.select("pack", "doc_id", "piece", "start", "length", "data").repartition("pack").sortWithinPartitions("pack")
    return dealt.mapInArrow(_packed(capacities), _BINS)


def pack_texts(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, path: str | None = None, group: int = GROUP) -> DataFrame:
    """The packed sequences of whole texts, a row for each bin; every row of ``docs`` is in one or more of them.

    Repeated rows and rows without a doc_id are packed each.  No rows give no bins.
    """
    return pack_pieces(token_pieces(docs, capacities, path), capacities, group)


def placements(bins: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, piece and start (of the text), length, pack, bin, offset, capacity, used."""
    rows = bins.select("pack", "bin", "capacity", "used", F.explode("documents").alias("d"))
    return rows.select("d.doc_id", "d.piece", "d.start", "d.length", "pack", "bin", "d.offset", "capacity", "used")


def pack_lengths(items: DataFrame, capacities: Sequence[int] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """The ``placements`` of (doc_id, length) rows without contents.

    An item longer than the largest size is cut into pieces of that size and a rest.
    Null and negative lengths count as zero; items of length zero are packed and take
    no room; rows without a doc_id and repeated rows are packed each.  No items give
    no rows.
    """
    most = max(capacities)
    sized = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / most) - 1, F.lit(0)))
    pieces = sized.select("doc_id", "length", F.explode(cuts).alias("piece")).select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.col("length") - F.col("piece") * most, F.lit(most)).alias("length"), F.lit(None).cast("binary").alias("data"))
    return placements(pack_pieces(pieces, capacities, group))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(x.as_py()) for x in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 3, 5)), pa.array(sums, pa.int64())], ["pack", "bin", "capacity", "used", "documents", "crc32"])


def op10(spark, sf_dir: str) -> DataFrame:
    """A row for each packed piece; ``crc32`` is that of its bin's sequence."""
    bins = pack_texts(table(spark, sf_dir, "documents")).mapInArrow(_sums, _BINS.replace("ids binary, ", "") + ", crc32 long")
    rows = bins.select("pack", "bin", "capacity", "used", "crc32", F.explode("documents").alias("d"))
    return rows.select("d.doc_id", "d.piece", "d.start", "d.length", "pack", "bin", "d.offset", "capacity", "used", "crc32")
