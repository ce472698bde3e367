"""The exact check of near copies, and the candidates that SimHash misses.

A 64-bit SimHash of two texts with similarity 0.8 differs in about ten bits, too many
for a grid of cells.  Further candidates come from prefixes: with shingles in any one
order, two sets of that similarity share one of their first
``size - ceil(0.8 size) + 1``.  At first each of these, in the order of their hashes,
links a text to its first and to its nearest earlier holder, which gathers large
groups.  Then all sets that share one, with the shingles that a sample finds frequent
last, and that no link has brought together are held against each other: by sketches
of their parities, which rule out only what can't be similar, and what these leave
exactly, in blocks of a cluster.  So none is missed, and only joining links are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, grouped
from .components import connected_components
from .substring import _linked, _roots, _whole_runs, word_hashes

#: Words of a shingle; least share of common shingles, in tenths.
SHINGLE, TENTHS = 5, 8
#: Bits in which the fingerprints of two sets of LARGE shingles or more may differ.  At a similarity
#: of 0.8 they differ in 9.7 of 64 on average, with a deviation of 2.9; unrelated ones in 32.
FAR, LARGE = 24, 50
#: Texts of the sample that tells frequent shingles; how often it has one at least; most of them.
#: They set the order of the shingles only: the candidates are complete under any order.
SAMPLE, OFTEN, FREQUENT = 8192, 3, 100_000
#: Bits of the smallest sketch; pairs of sketches compared at a time; shingles of one side of a block of sets.
SKETCH, PAIRS, BLOCK_SHINGLES = 256, 1 << 18, 1 << 18
#: Sets that are held against one in the same task, on average.
BLOCK = 1024


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct runs of SHINGLE words; of a shorter text one hash of all its words."""
    words = word_hashes(text)
    size = min(SHINGLE, len(words))
    if not size:
        return np.zeros(1, np.uint64)
    n = len(words) - size + 1
    run = words[:n] + np.uint64(size)
    for k in range(1, size):
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(run ^ run >> np.uint64(32))


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; texts of equal sets are copies."""
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, in the columns of ``substring._linked``; ``pos`` is the set's size.

    Of the copies of a set within one partition the first stands for all.
    """
    seen: set[int] = set()
    for batch in batches:
        parts, nodes, sizes = [np.empty(0, np.uint64)], [], []
        for text in batch.column(0):
            s = shingles(text.as_py())
            node = node_of(s)
            if node not in seen:
                seen.add(node)
                parts.append(s[: len(s) + (-TENTHS * len(s) // 10) + 1])
                nodes.append(node)
                sizes.append(len(s))
        counts = [len(p) for p in parts[1:]]
        h = np.concatenate(parts).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.full(len(h), -1, np.int32)), pa.array(np.zeros(len(h), np.int64))], ["h", "doc", "pos", "before", "sides"])


def prefix_candidates(texts: DataFrame) -> DataFrame:
    """(a, b, size): the node of each ``text`` with those of the first and the nearest holder of its prefix shingles, if their sizes allow 0.8.

    ``size`` is the smaller set's.
    """
    prefixes = texts.select("text").mapInArrow(_prefixes, "h long, doc long, pos int, before int, sides long")
    links = prefixes.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(_linked, "doc long, ref long, pos int, at int, agree int")
    return links.where(10 * F.least("pos", "at") >= TENTHS * F.greatest("pos", "at")).select(F.col("doc").alias("a"), F.col("ref").alias("b"), F.least("pos", "at").alias("size"))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.empty(0, np.uint64), *(shingles(text.as_py()) for text in batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that a sample of the texts of ``rows`` (doc, hash, text) has most often."""
    share = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("doc", "hash"), F.lit(share)) == 0).select("text").mapInArrow(_shingles, "h long")
    found = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    hashes, counts = found.column("h").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(own: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, the frequent ones last; another set of similarity 0.8 has one of them in its own."""
    size = len(own) + (-TENTHS * len(own) // 10) + 1
    if not len(hashes):
        return own[:size]
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return own[np.argsort(np.where(hashes[at] == own, counts[at], 0), kind="stable")][:size]


def sketch(own: np.ndarray) -> bytes:
    """How often the shingles of a set fall in each of ``SKETCH`` << k places, odd or even; a bit for each.

    Two sets differ in as many shingles at least as their sketches do in bits.
    """
    places = SKETCH << _level(len(own))
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def _level(size):
    """k of the least ``SKETCH`` << k that isn't below ``size``."""
    return np.ceil(np.log2(np.maximum(size, SKETCH) / SKETCH)).astype(np.int64)


def _window(group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group and size: the first and the end of those in its group whose sizes allow 0.8 with each."""
    key = group << 40 | size
    return np.searchsorted(key, group << 40 | -(-TENTHS * size // 10)), np.searchsorted(key, group << 40 | 10 * size // TENTHS, side="right")


def _by_size(h: np.ndarray, node: np.ndarray, size: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """(group, node, size, others): each node of a shingle once, by shingle and size."""
    order = np.lexsort((node, size, h))
    h, node = h[order], node[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
    order = order[new]
    return [np.cumsum(np.r_[True, h[new][1:] != h[new][:-1]]), node[new], size[order], *(c[order] for c in others)]


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node): of rows (h, node, size, root) sorted by h those that hold their shingle together with a set of another root whose size allows 0.8."""
    for h, node, size, root in _whole_runs(batches, 1):
        group, node, size, root, h = _by_size(h, node, size, root, h)
        lo, hi = _window(group, size)
        changes = np.cumsum(np.r_[False, root[1:] != root[:-1]])
        some = changes[hi - 1] > changes[lo]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(node[some])], ["h", "node"])


def _reached(root: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``root`` (a place of the smallest label for each) after the links (a, b)."""
    return _roots(len(root), np.concatenate([np.arange(len(root)), *a]), np.concatenate([root, *b]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest, shingle by shingle, of the sets under different roots that may be similar by their sketches; rows (h, node, size, root, sketch) sorted by h."""
    for h, node, size, root, bits in _whole_runs(batches, 1):
        group, node, size, root, bits = _by_size(h, node, size, root, bits)
        end, level, forest = _window(group, size)[1], _level(size), np.arange(len(node))
        for k in np.unique(level).tolist():
            # a larger set's sketch may be twice as long: it is folded
            rows = np.flatnonzero((level == k) | (level == k + 1))
            words = (SKETCH << k) // 64
            place, marks = np.cumsum((level == k) | (level == k + 1)) - 1, np.empty((len(rows), words), np.uint64)
            for longer in (0, 1):
                these = np.flatnonzero(level[rows] == k + longer)
                folded = np.frombuffer(b"".join(bits[rows[these]]), np.uint64).reshape(len(these), 1 + longer, words)
                marks[these] = np.bitwise_xor.reduce(folded, axis=1)
            i, step, a, b, held = np.flatnonzero(level == k), 0, [], [], 0
            while len(i):  # each with the one that lies ``step`` rows behind
                step += 1
                i = i[i + step < end[i]]
                x = i[(root[i] != root[i + step]) & (forest[i] != forest[i + step])]
                for at in range(0, len(x), PAIRS):
                    y = x[at : at + PAIRS]
                    z = y + step
                    differ = np.bitwise_count(marks[place[y]] ^ marks[place[z]]).sum(1, dtype=np.int64)
                    near = (10 + TENTHS) * differ <= (10 - TENTHS) * (size[y] + size[z])
                    a.append(y[near])
                    b.append(z[near])
                    held += len(a[-1])
                if held > len(node):
                    forest, a, b, held = _reached(forest, a, b), [], [], 0
            if held:
                forest = _reached(forest, a, b)
        rest = np.flatnonzero(forest != np.arange(len(node)))
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.array(node[forest[rest]])], ["a", "b"])


def _named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([shingles(t.as_py()).tobytes() for t in batch.column(4)], pa.binary())], ["cluster", "slots", "node", "root", "set"])


def _joining(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Links of sets of similarity 0.8 that join all that such links reach; sets with one ``root`` are joined, and those of one ``side`` are not compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, begins = sizes[order], np.cumsum(np.r_[0, sizes[order]])
    names, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    side = None if side is None else side[order]
    top, has, end = np.unique(root[order], return_inverse=True)[1], np.zeros(len(names), np.int32), _window(np.zeros_like(sizes), sizes)[1]
    for x in range(len(sizes)):
        y = x + 1 + np.flatnonzero(top[x + 1 : end[x]] != top[x])
        if side is not None:
            y = y[side[y] != side[x]]
        if not len(y):
            continue
        own, at = ids[begins[x] : begins[x + 1]], np.cumsum(np.r_[0, sizes[y][:-1]])
        has[own] = 1
        both = np.add.reduceat(has[ids[np.repeat(begins[y] - at, sizes[y]) + np.arange(sizes[y].sum())]], at)
        has[own] = 0
        y = y[10 * both >= TENTHS * (sizes[x] + sizes[y] - both)]
        if len(y):
            tops, firsts = np.unique(top[y], return_index=True)
            yield from ((int(order[x]), int(order[k])) for k in y[firsts])
            top[np.isin(top, tops)] = top[x]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): similar sets of each block, as many as join their classes; rows (cluster, i, j, slot, node, root, set) sorted by block."""
    for block in grouped(batches, 3):
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        node, root, slot = (block.column(c).to_numpy() for c in ("node", "root", "slot"))
        once = np.unique(node, return_index=True)[1]  # rows that repeat a doc_id and its text
        sets = block.column("set").to_pylist()
        found = list(_joining([np.frombuffer(sets[k], np.uint64) for k in once], root[once], None if i == j else slot[once]))
        if found:
            a, b = node[once][np.array(found)].T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def crossing_links(rows: DataFrame, own: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links between sets of similarity 0.8 that have no common root in ``roots`` (node, root), as many as join what all such links reach.

    ``rows`` has (doc, hash, text), ``own`` (node, doc, hash, size, sketch).  A node without
    a root is its own.  Sets that share a prefix shingle and whose sketches allow 0.8 are
    gathered in clusters, and inside each all sets under different roots are compared
    exactly, in blocks.  No table has a row for each pair.
    """
    order = rows.sparkSession.sparkContext.broadcast(frequent(rows))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a set within one partition are one
        for batch in batches:
            nodes, sizes, parts = [], [], [np.empty(0, np.uint64)]
            for text in batch.column(0):
                own = shingles(text.as_py())
                node = node_of(own)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(own))
                    parts.append(prefix(own, *order.value))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts[1:])]), pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists], ["node", "size", "shingles"])

    sets = rows.select("text").mapInArrow(prefixes, "node long, size long, shingles array<long>")
    sets = sets.join(roots.hint("merge"), "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), F.explode("shingles").alias("h"))
    held = sets.select("h", "node", "size", "root").repartition("h").sortWithinPartitions("h")
    live = checkpoint(held.mapInArrow(_live, "h long, node long"))
    of = own.join(roots.hint("merge"), "node", "left").select("node", "doc", "hash", "size", F.coalesce("root", "node").alias("root"), "sketch")
    held = live.join(of.hint("merge"), "node").select("h", "node", "size", "root", "sketch").repartition("h").sortWithinPartitions("h")
    clusters = checkpoint(connected_components(checkpoint(held.mapInArrow(_gathered, "a long, b long")), "a", "b").withColumnRenamed("root", "cluster"))
    slots = checkpoint(clusters.join(of.select("node", "size").hint("merge"), "node").groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("slots")))
    members = clusters.join(slots, "cluster").join(of.select("node", "doc", "hash", "root").hint("merge"), "node")
    texts = members.join(rows.hint("merge"), ["doc", "hash"]).select("cluster", "slots", "node", "root", "text")
    texts = texts.mapInArrow(_named_sets, "cluster long, slots long, node long, root long, set binary").withColumn("slot", F.pmod(F.xxhash64("node"), "slots"))
    blocks = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    blocks = blocks.select("cluster", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "node", "root", "set")
    return blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_compared, "a long, b long")


def near_prints(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, size) whose fingerprints in ``own`` (node, fp) are not FAR apart; small sets all pass."""
    fps = lambda c: own.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp")).hint("merge")
    both = pairs.groupBy("a", "b").agg(F.min("size").alias("size")).join(fps("a"), "a").join(fps("b"), "b")
    return both.where((F.col("size") < LARGE) | (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= FAR)).select("a", "b")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([shingles(t.as_py()).tobytes() for t in batch.column(4)], pa.binary())], ["b", "part", "member", "node", "set"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each part that are similar to its first row, of which the set is held; the rest streams by."""
    hub, of = None, None
    for batch in batches:
        found = []
        for b, part, member, node, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            own = np.frombuffer(raw.as_py(), np.uint64)
            if not member:
                hub, of = own, (b, part)
            elif (b, part) == of:
                both = len(np.intersect1d(own, hub, assume_unique=True))
                if 10 * both >= TENTHS * (len(own) + len(hub) - both):
                    found.append((node, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def similar(rows: DataFrame, own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes whose similarity, computed exactly, is 0.8 or more.

    ``rows`` (doc, hash, text) has the texts and ``own`` (node, doc, hash) the text that
    stands for each node.  The sets held against one node are dealt over as many
    parts as their number asks for.
    """
    parts = checkpoint(pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    members = pairs.join(parts, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("member"))
    hubs = parts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    needs = checkpoint(members.unionByName(hubs).join(own.hint("merge"), "node"))
    # rows that repeat a doc_id and its text meet here again; their pairs are the same
    texts = needs.join(rows.hint("merge"), ["doc", "hash"]).select("b", "part", "member", "node", "text")
    sets = texts.mapInArrow(_sets, "b long, part int, member int, node long, set binary")
    return sets.repartition("b", "part").sortWithinPartitions("b", "part", "member").mapInArrow(_similar, "a long, b long")
