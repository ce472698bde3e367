"""Substring dedup: shared seeds, collinear chains with gap costs, and alignment.

Every text is cut into words, and a run of ``SEED`` words is a seed if none of its
words has a smaller hash than the first.  Whether a run is one depends on its own
words alone, so a copy keeps every seed whose words it keeps.  A seed that occurs
twice or more links each later occurrence to its first document and to the nearest
earlier one, which keeps the number of links below twice the number of seeds however
often a passage occurs.  The
first gathers the copies of a passage, the nearest follows one that changes from
version to version.  The links of two documents are chained: a Fenwick tree finds the
best chain that ends before each link, gaps cost by their length in both documents.
Chains are aligned word by word, extended at their ends, and reported as passages
where enough words agree.

A seed of up to ``PAIRED`` documents has all its pairs among these links.  Of a seed
of more, every pair of occurrences that the passages found so far have not brought
together is held against each other by the words around, and those that may lie in
one passage are chained and aligned as well.

Seeds and links are dealt out in bundles, one for each bucket of keys that a task has
rows of: columns of few bytes, sorted where they arrive.  Chains without a break are
aligned many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import checkpoint, grouped, packed, partitions_for, release, table, unpacked

#: Words of a seed; about one run of so many words in SEED is one.
SEED = 4
#: Words of the shortest passage reported, and the share of aligned words that agree.
MIN_WORDS, SIMILARITY = 50, 0.8
#: Cost of a word in a gap of a chain; words of the shortest piece of a passage.
GAP_COST, CHAIN_WORDS = 0.05, 16
#: Words on each side of a seed of which it carries four bits; how many of both sides must agree
#: (one does by chance) before a chain of less than CHAIN_WORDS, such as a single link, is aligned.
SIDE, NEAR = 8, 7
#: How many of the 2 * SIDE words on each side of two occurrences of a seed must agree, in their places or one beside, before
#: occurrences other than the first and the nearest are linked, besides NEAR.  Of edited passages 0.94 to 1 have such a seed.
WIDE_NEAR = 20
#: Documents of a seed whose pairs are all linked at first; pairs of a seed's other occurrences compared at a time.
PAIRED, COMPARED = 3, 1 << 16
#: Words between two pieces of one passage that have different sources.
JOIN = 2
#: Words at the ends of an edited passage that may be edited themselves, so that they aren't found.
EDGE = 2
#: Words around a chain that an alignment may extend into; words of a tile.  Of two texts that
#: agree in 0.82 of their words, a stretch of MARGIN words without a common seed has odds of 0.005.
MARGIN, TILE = 64, 128
#: Chains that begin in one stretch of so many words of a text are aligned together.
GROUP_WORDS = 2048
#: Extension: score of an equal and of a different word, and the fall that ends it.
MATCH, MISMATCH, DROP = 2, -1, 16
#: Words on the two sides that an extension may step over where a word was put in or left out; it
#: goes on if LOOK_NEED of the LOOK words behind agree.
SHIFTS = [(1, 0), (0, 1), (2, 0), (0, 2), (2, 1), (1, 2), (3, 2), (2, 3), (3, 1), (1, 3)]
LOOK, LOOK_NEED = 6, 4
#: Words of a gap that find no partner, above which a chain is two passages.
BREAK = 12
#: Rows that are packed at a time into bundles, which are dealt out and sorted in place of rows; distinct words whose hashes are kept.
BUNDLED, KNOWN = 1 << 19, 1 << 17


class _Hashes(dict):
    """The hash of each short word met, up to KNOWN of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 32:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the chosen runs of a text."""
    n = len(hashes) - SEED + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = hashes[1 : n + 1].copy()
    for k in range(2, SEED):
        np.minimum(least, hashes[k : k + n], out=least)
    at = np.flatnonzero(hashes[:n] <= least)
    run = hashes[at]
    for k in range(1, SEED):
        run = run * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    return run, at


def _sides(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bits of each of the SIDE words before and behind the seeds, in one integer, and of the SIDE beyond; 0 where there is no word."""
    four = np.zeros(len(hashes) + 4 * SIDE, np.uint64)
    four[2 * SIDE : -2 * SIDE] = (hashes >> np.uint64(20)) % np.uint64(15) + np.uint64(1)
    n = len(four) - SIDE + 1
    run = np.zeros(n, np.uint64)
    for k in range(SIDE):
        run |= four[k : k + n] << np.uint64(4 * k)
    pair = lambda lo, hi: (run[at + lo] | run[at + hi] << np.uint64(4 * SIDE)).view(np.int64)
    return pair(SIDE, 2 * SIDE + SEED), pair(0, 3 * SIDE + SEED)


_ONES = np.uint64(0x1111111111111111)


def _marks(x: np.ndarray) -> np.ndarray:
    """The lowest bit of each four is set if one of them is."""
    x = x | x >> np.uint64(2)
    return (x | x >> np.uint64(1)) & _ONES


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of two values of ``_sides`` agree."""
    return (2 * SIDE - np.bitwise_count(_marks((a ^ b).view(np.uint64)))).astype(np.int32)


def _earlier(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each seed: where its text has the same seed first (-1: here), and how often before.

    The count is part of a seed's key between texts.  So the third place of a seed in
    a text full of repeats meets the third place in another, and the links rise.
    """
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = ranked[1:] != ranked[:-1]
    if new.all():
        return np.full(len(h), -1), np.zeros(len(h), np.uint64)
    begins = np.flatnonzero(np.r_[True, new])
    sizes = np.diff(np.r_[begins, len(h)])
    first, ordinal = np.empty(len(h), np.int64), np.empty(len(h), np.uint64)
    first[order] = np.repeat(at[order][begins], sizes)
    ordinal[order] = np.arange(len(h)) - np.repeat(begins, sizes)
    return np.where(first == at, -1, first), ordinal


def _bits(spark) -> int:
    """Bits of a bucket's number: there are no fewer buckets than shuffle partitions, and 256 at least."""
    return min(16, max(8, (partitions_for(spark) - 1).bit_length()))


def _bundled(columns: list[np.ndarray], bits: int, kind: int = 0) -> pa.RecordBatch:
    """Bundles of rows whose first columns fall in one bucket: each column as its least value and the differences to it."""
    bucket = ((columns[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = [int(c.min()) for c in columns]
    widths = [next(w for w in (1, 2, 4, 8) if int(c.max()) - low < 1 << 8 * w) for c, low in zip(columns, least)]
    head = np.array([least, widths], np.int64).tobytes()
    parts = [(c[order].view(np.uint64) - np.uint64(low % (1 << 64))).astype(f"u{w}") for c, low, w in zip(columns, least, widths)]
    data = [b"".join([head, *(c[lo:hi].tobytes() for c in parts)]) for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begins].astype(np.int32)), pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _bundles(rows: Iterator[list[np.ndarray]], bits: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Bundles of rows in columns of whole numbers, about BUNDLED rows at a time."""
    held, count = [], 0
    for columns in rows:
        if len(columns[0]):
            held.append(columns)
            count += len(columns[0])
        if count >= BUNDLED:
            yield _bundled([np.concatenate(c).astype(np.int64, copy=False) for c in zip(*held)], bits, kind)
            held, count = [], 0
    if held:
        yield _bundled([np.concatenate(c).astype(np.int64, copy=False) for c in zip(*held)], bits, kind)


_BUNDLES = "bucket int, kind int, data binary"


def _dealt(bundles: DataFrame) -> DataFrame:
    """Bundles with all those of a bucket together."""
    return bundles.repartition("bucket").sortWithinPartitions("bucket", "kind")


def _opened(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(kind, columns) of each bucket and kind of dealt bundles, rows sorted by the columns ``keys``."""
    held, last = [], None

    def rows() -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort([columns[k] for k in reversed(keys)])
        return [c[order] for c in columns]

    for batch in batches:
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if held and (bucket, kind) != last:
                yield last[1], rows()
                held = []
            last = (bucket, kind)
            data = data.as_buffer()
            n = _COLUMNS[kind]
            least, widths = np.frombuffer(data, np.int64, 2 * n).reshape(2, n).tolist()
            size, at, columns = (len(data) - 16 * n) // sum(widths), 16 * n, []
            for low, w in zip(least, widths):
                columns.append((np.frombuffer(data, f"u{w}", size, at).astype(np.uint64) + np.uint64(low % (1 << 64))).view(np.int64))
                at += w * size
            held.append(columns)
    if held:
        yield last[1], rows()


#: Kinds of bundles and their columns: seeds (h, doc, pos, before, sides, wide), links (doc, ref, pos, at, agree), a
#: document's seeds that many hold (doc, h, pos, sides, wide), those with stretches of their sources (h, doc, pos, sides, wide, ref, x0, x1).
_SEEDS, _LINKED, _MANY, _PLACED = range(4)
_COLUMNS = (6, 5, 5, 8)


def _seeded(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = word_hashes(text.as_py())
                h, at = seeds(hashes)
                if not len(h):
                    continue
                before, ordinal = _earlier(h, at)
                yield [(h ^ (ordinal * np.uint64(0xD1B54A32D192ED03))).view(np.int64), np.full(len(h), doc, np.int64), at, before, *_sides(hashes, at)]

    return _bundles(rows(), bits, _SEEDS)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """The links of seeds sorted by hash and document, and the rows (doc, h, pos, sides and what follows) of hashes of more than PAIRED rows.

    Of the last hash only its first rows and its last one are carried on.
    """
    held: list[np.ndarray] | None = None  # the first rows and the last row of a hash that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        known = 0
        if held is not None:
            known = len(held[0])
            columns = [np.concatenate(c) for c in zip(held, columns)]
        h, doc, pos, before, sides, *others = columns
        rows = np.arange(len(h))
        first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], rows, 0))
        own = rows[known:]
        old = own[doc[first[own]] != doc[own]]
        near = old[(first[old] != old - 1) & (doc[old - 1] != doc[old])]
        again = own[before[own] >= 0]
        left, right = np.r_[old, near], np.r_[first[old], near - 1]
        agree = np.r_[_agreeing(sides[left], sides[right]), np.zeros(len(again), np.int32)]
        place = own - first[own]
        begun = first[own[place == PAIRED]]
        many = np.r_[(begun[:, None] + np.arange(PAIRED)).ravel(), own[place >= PAIRED]]
        yield [np.r_[doc[left], doc[again]], np.r_[doc[right], doc[again]], np.r_[pos[left], pos[again]], np.r_[pos[right], before[again]], agree], [c[many] for c in (doc, h, pos, sides, *others)]
        ends = np.unique([*range(first[-1], min(first[-1] + PAIRED, rows[-1])), rows[-1]])
        held = [c[ends] for c in columns]


_LINKS = ["doc", "ref", "pos", "at", "agree"]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each row to the first and to the nearest earlier document of its hash."""
    for links, _ in _links(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], _LINKS)


def _linked_and_many(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The same of dealt bundles of seeds, in bundles, with the rows of hashes of more than PAIRED rows."""
    held = ([], [])
    counts = [0, 0]
    found = (pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc", "pos", "before", "sides", "wide"]) for _, columns in _opened(batches, (0, 1)))
    for both in _links(found):
        for k, (columns, kind) in enumerate(zip(both, (_LINKED, _MANY))):
            held[k].append(columns)
            counts[k] += len(columns[0])
            if counts[k] >= BUNDLED:
                yield from _bundles(iter(held[k]), bits, kind)
                held[k].clear()
                counts[k] = 0
    for columns, kind in zip(held, (_LINKED, _MANY)):
        yield from _bundles(iter(columns), bits, kind)


def chain(x: np.ndarray, y: np.ndarray, size: int = SEED, gap: float = GAP_COST) -> list[np.ndarray]:
    """Chains of links (x in the first, y in the second text), best first; both rise along a chain.

    A link is worth its ``size`` words.  One that follows another leaves out words on
    both sides, each at the cost of ``gap``, or overlaps it on the same diagonal and
    is worth its new words.  Every link is in one chain at most; the first chain is
    the best there is.
    """
    order = np.lexsort((x, y))
    return [order[np.array(path)] for path in _paths(x[order], y[order], size, gap)]


def _paths(x: np.ndarray, y: np.ndarray, size: int = SEED, gap: float = GAP_COST) -> list[list[int]]:
    """The same for links sorted by ``y`` and ``x``, as lists."""
    n = len(x)
    values = np.unique(x)
    ranks = (np.searchsorted(values, x) + 1).tolist()
    before = np.searchsorted(values, x - size, side="right").tolist()  # links that end before this one, by x
    top = len(values) + 1
    tree_score, tree_link = [-1e18] * top, [-1] * top
    score, back = [0.0] * n, [-1] * n
    diagonal: dict[int, int] = {}
    xs, ys = x.tolist(), y.tolist()
    ended = 0
    for i in range(n):
        while ys[ended] + size <= ys[i]:  # links that end before this one, by y, enter the tree
            value, r = score[ended] + gap * (xs[ended] + ys[ended] + 2 * size), ranks[ended]
            while r < top:
                if value > tree_score[r]:
                    tree_score[r], tree_link[r] = value, ended
                r += r & -r
            ended += 1
        best, link, r = -1e18, -1, before[i]
        while r:
            if tree_score[r] > best:
                best, link = tree_score[r], tree_link[r]
            r -= r & -r
        at = xs[i]
        best -= gap * (at + ys[i])
        slope = at - ys[i]
        j = diagonal.get(slope, -1)
        if j >= 0 and at - xs[j] < size and score[j] + at - xs[j] >= best + size:
            score[i], back[i] = score[j] + at - xs[j], j
        elif best > 0:
            score[i], back[i] = best + size, link
        else:
            score[i] = float(size)
        diagonal[slope] = i
    used, chains = bytearray(n), []
    for end in sorted(range(n), key=score.__getitem__, reverse=True):
        path = []
        i = end
        while i >= 0 and not used[i]:
            used[i] = 1
            path.append(i)
            i = back[i]
        if path:
            path.reverse()
            chains.append(path)
    return chains


#: Words between the places of two links on one diagonal up to which the later is worth more with the earlier than alone.
_NEAR_STEP = SEED + int(SEED / (2 * GAP_COST))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that rows which agree in the first ``keys`` columns stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(batch.num_rows, bool)
        change[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(columns[:keys], held[-1]))
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(columns)
            continue
        last = int(cuts[-1])
        held.append([c[:last] for c in columns])
        yield [np.concatenate(c) for c in zip(*held)]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


_CHAINS = ["doc", "ref", "y0", "y1", "x0", "x1", "ys", "xs"]
_CHAIN_TYPES = "doc long, ref long, y0 int, y1 int, x0 int, x1 int, ys array<int>, xs array<int>, hs array<long>, ss array<long>, ws array<long>"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of dealt bundles of links; pairs with a single link among other words are left out.

    Bundles of ``_linked_and_many`` that aren't links become rows of a document's places (``ys``), hashes and sides.
    """
    for kind, columns in _opened(batches, (0, 1, 2)):
        if kind == _MANY:
            yield _many_rows(*columns)
            continue
        doc, ref, y, x, agree = columns
        begins = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1])])
        ends = np.r_[begins[1:], len(doc)]
        sizes = ends - begins
        # pairs whose links follow each other closely on one diagonal are one chain
        step = np.diff(y, prepend=0)
        apart = (np.diff(x, prepend=0) != step) | (step > _NEAR_STEP) | (step < 1)
        apart[begins] = False
        straight = np.add.reduceat(apart, begins, dtype=np.int64) == 0
        alone = (sizes == 1) & (agree[begins] < NEAR)
        whole = straight & ~alone & ((y[ends - 1] + SEED - y[begins] >= CHAIN_WORDS) | (np.maximum.reduceat(agree, begins) >= NEAR))
        if whole.any():
            links, b, e = np.repeat(whole, sizes), begins[whole], ends[whole] - 1
            yield _chain_rows(doc[b], ref[b], y[b], y[e] + SEED, x[b], x[e] + SEED, sizes[whole], y[links], x[links])
        kept: list[np.ndarray] = []
        for k in np.flatnonzero(~straight).tolist():
            lo, hi = int(begins[k]), int(ends[k])
            order = lo + np.lexsort((x[lo:hi], y[lo:hi]))
            gy, near = y[order].tolist(), agree[order].tolist()
            kept += [order[c] for c in _paths(x[order], y[order]) if gy[c[-1]] + SEED - gy[c[0]] >= CHAIN_WORDS or max([near[i] for i in c]) >= NEAR]
        if kept:
            links, b, e = np.concatenate(kept), np.array([c[0] for c in kept]), np.array([c[-1] for c in kept])
            yield _chain_rows(doc[b], ref[b], y[b], y[e] + SEED, x[b], x[e] + SEED, np.array([len(c) for c in kept]), y[links], x[links])


def _many_rows(doc: np.ndarray, h: np.ndarray, pos: np.ndarray, sides: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    cuts, n = pa.array(np.r_[begins, len(doc)], pa.int32()), len(begins)
    ys, hs, ss, ws = (pa.ListArray.from_arrays(cuts, c) for c in (pa.array(pos, pa.int32()), pa.array(h), pa.array(sides), pa.array(wide)))
    return pa.RecordBatch.from_arrays([pa.array(doc[begins]), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int32()) for _ in range(4)), ys, pa.nulls(n, ys.type), hs, ss, ws], [*_CHAINS, "hs", "ss", "ws"])


def _chain_rows(doc: np.ndarray, ref: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray, sizes: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> pa.RecordBatch:
    cuts = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(c, pa.int32())) for c in (ys, xs)]
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(ref), *(pa.array(c, pa.int32()) for c in (y0, y1, x0, x1)), *lists, *(pa.nulls(len(doc), pa.list_(pa.int64())) for _ in range(3))], [*_CHAINS, "hs", "ss", "ws"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(h, doc, pos, sides, wide, ref, x0, x1): each seed of rows (doc, ys, hs, ss, ws, spans) with the stretches that its passages take it from in the first and the last of their sources, or an empty one."""
    for batch in batches:
        for doc, ys, hs, ss, ws, spans in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 5)), batch.column(5).to_pylist()):
            y, h, s, w = (c.values.to_numpy() for c in (ys, hs, ss, ws))
            spans = sorted(spans or (), key=lambda x: x["ref_doc_id"])
            low, high = np.full(len(y), -1), np.full(len(y), -1)
            for k, x in enumerate(spans):
                at = np.flatnonzero((y >= x["start_word"]) & (y + SEED <= x["end_word"]))
                low[at] = np.where(low[at] < 0, k, low[at])
                high[at] = k
            of = np.array([(x["ref_doc_id"], x["ref_start"], x["ref_end"]) for x in spans] + [(0, 0, 0)], np.int64)
            for at, k in ((slice(None), low), (high > low, high)):
                ref, x0, x1 = of[k[at]].T
                yield [h[at], np.full(len(ref), doc, np.int64), y[at], s[at], w[at], ref, x0, x1]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _around(parts: list[np.ndarray], has: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words around the occurrences ``a`` are around ``b`` too, in their places or one beside."""
    count = 0
    for part, own in zip(parts, has):
        x, y = part[a], part[b]
        count = count + np.bitwise_count(own[a] & ~(_marks(x ^ y) & _marks(x ^ (y << np.uint64(4))) & _marks(x ^ (y >> np.uint64(4)))))
    return count


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The links of all occurrences of a seed whose surroundings agree and that no passage has brought together; dealt bundles of ``_placed``."""
    for _, (h, doc, pos, sides, wide, ref, x0, x1) in _opened(batches, (0, 1, 2)):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
        node = np.cumsum(new) - 1
        cover = np.flatnonzero(x1 > x0)
        cover_node, ref, x0, x1 = node[cover], ref[cover], x0[cover], x1[cover]
        h, doc, pos, sides, wide = (c[new] for c in (h, doc, pos, sides.view(np.uint64), wide.view(np.uint64)))
        # the words before and those behind, four bits each, from far to near and from near to far
        half, low = np.uint64(4 * SIDE), np.uint64((1 << 4 * SIDE) - 1)
        parts = [(wide & low) | sides << half, (sides >> half) | (wide >> half << half)]
        has, has_parts = _marks(sides), [_marks(c) for c in parts]
        # how many words are around each occurrence, and at how many places there is one or one beside
        words = sum(np.bitwise_count(c) for c in has_parts)
        near = sum(np.bitwise_count(c | c << np.uint64(4) | c >> np.uint64(4)) for c in has_parts)
        starts = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(starts) - 1
        docs, dense = np.unique(doc, return_inverse=True)
        key = group * len(docs) + dense
        at = np.minimum(np.searchsorted(docs, ref), len(docs) - 1)
        wanted = group[cover_node] * len(docs) + at
        to = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        ok = (docs[at] == ref) & (key[to] == wanted) & (pos[to] >= x0) & (pos[to] < x1)
        root = _roots(len(h), cover_node[ok], to[ok])
        begins = np.flatnonzero(starts)
        ends = np.r_[begins[1:], len(h)]
        held, count = [], 0
        for k in np.flatnonzero(np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)).tolist():
            lo, hi = int(begins[k]), int(ends[k])
            top, text = root[lo:hi], doc[lo:hi]
            names, sizes = np.unique(top, return_counts=True)
            large = top == names[sizes.argmax()]
            # pairs within the largest class are none, nor those of an occurrence with too few words around
            rest = np.flatnonzero(~large & (words[lo:hi] >= WIDE_NEAR))
            others = np.r_[np.flatnonzero(large & (near[lo:hi] >= WIDE_NEAR)), np.flatnonzero(~large & (near[lo:hi] >= WIDE_NEAR))]
            few, around_it, ones = int((large[others]).sum()), sides[lo:hi], has[lo:hi]
            step = max(1, COMPARED // max(1, len(others)))
            for m in range(0, len(rest), step):
                some = rest[m : m + step]
                with_ = others[: few + int(np.searchsorted(others[few:], some[-1], "right"))]
                # words that agree of all pairs at once, as in _agreeing, those without a word left out
                unlike = around_it[some, None] ^ around_it[with_]
                unlike |= unlike >> np.uint64(2)
                unlike |= unlike >> np.uint64(1)
                np.invert(unlike, out=unlike)
                unlike &= ones[some, None]
                agree = np.bitwise_count(unlike)
                passed = agree >= NEAR
                if 4 * np.count_nonzero(passed) > passed.size:  # most seeds have few such pairs, which are taken out first
                    passed &= _around(parts, has_parts, lo + some[:, None], lo + with_) >= WIDE_NEAR
                i, j = np.nonzero(passed)
                agree = agree[i, j]
                a, b = some[i], with_[j]
                ok = np.flatnonzero((top[a] != top[b]) & (text[a] != text[b]) & (large[b] | (b < a)))
                a, b, agree = lo + a[ok], lo + b[ok], agree[ok]
                ok = _around(parts, has_parts, a, b) >= WIDE_NEAR
                late, early = np.maximum(a[ok], b[ok]), np.minimum(a[ok], b[ok])
                held.append((doc[late], doc[early], pos[late], pos[early], agree[ok].astype(np.int32)))
                count += len(late)
                if count >= COMPARED:
                    yield [np.concatenate(c) for c in zip(*held)]
                    held, count = [], 0
        if held:
            yield [np.concatenate(c) for c in zip(*held)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of texts, TILE at a time, as 32 bits each: two different words are taken for equal once in 4e9."""
    for batch in batches:
        docs, numbers, data = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = word_hashes(text.as_py()).astype(np.uint32)
            for k in range(0, len(words), TILE):
                docs.append(doc)
                numbers.append(k // TILE)
                data.append(words[k : k + TILE].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], ["doc", "tile", "words"])


def _gap(a: np.ndarray, b: np.ndarray, band: int = BREAK) -> int:
    """Most words of two gaps that agree in order, if all but ``band`` of the longer's do; otherwise no more than that.

    An alignment that leaves out at most ``band`` words of the longer gap strays no
    further than that from the diagonal, so only a band around it is computed.
    """
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > band:
        return 0
    if n == m:
        same = int((a == b).sum())
        if same >= n - 1:
            return same
    if m <= 64 * band:
        # Hyyro's bits: a place of b is 0 in ``free`` if the longest common subsequence grows there; without a band
        places: dict[int, int] = {}
        for j, w in enumerate(b.tolist()):
            places[w] = places.get(w, 0) | 1 << j
        free = full = (1 << m) - 1
        for w in a.tolist():
            used = free & places.get(w, 0)
            free = (free + used | free - used) & full
        return m - free.bit_count()
    # row[j]: the longest common subsequence of a[:i] and b[: i - band + j]
    width = 2 * band + 1
    padded = np.zeros(m + 2 * width, b.dtype)
    padded[width : width + m] = b
    inside = np.zeros(m + 2 * width, bool)
    inside[width : width + m] = True
    row = np.zeros(width + 1, np.int32)
    for i in range(n):
        lo = width + i - band
        if lo >= width + m:
            break
        hit = (padded[lo : lo + width] == a[i]) & inside[lo : lo + width]
        # the same column of the row before lies one place further; its left neighbour at the same place
        step = np.maximum(row[1:], row[:-1] + hit)
        row[:-1] = np.maximum.accumulate(step)
        row[-1] = row[-2]
    return int(row.max())


def _straight(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, agreeing words) that an extension without gaps gains; it stops when its score falls by DROP."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, MATCH, MISMATCH))
    best = np.maximum.accumulate(np.maximum(score, 0))
    fell = np.flatnonzero(best - score > DROP)
    limit = fell[0] if len(fell) else n
    if not limit or score[:limit].max() <= 0:
        return 0, 0
    end = int(score[:limit].argmax()) + 1
    return end, int(same[:end].sum())


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(words of ``a``, of ``b``, agreeing words, aligned words) that an extension along both sides gains."""
    i = j = same = total = 0
    while True:
        words, equal = _straight(a[i:], b[j:])
        i, j, same, total = i + words, j + words, same + equal, total + words
        for da, db in SHIFTS:
            p, q = a[i + da : i + da + LOOK], b[j + db : j + db + LOOK]
            n = min(len(p), len(q))
            if n >= LOOK_NEED and np.count_nonzero(p[:n] == q[:n]) >= LOOK_NEED:
                i, j, total = i + da, j + db, total + max(da, db)
                break
        else:
            return i, j, same, total


def align(left: np.ndarray, right: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(y0, y1, x0, x1, agreeing words, aligned words) of each passage of a chain between two stretches of words.

    ``left`` holds the later text's words and ``ys`` the chain's places in it,
    ``right`` and ``xs`` those of the earlier text.  The chain is cut at gaps with
    more than BREAK words without a partner, and each part is extended into them.
    """
    found = []
    y, x = int(ys[0]), int(xs[0])
    floor_y = floor_x = 0

    def begin() -> tuple[int, int, int, int]:
        back_y, back_x, same, total = _reach(left[floor_y:y][::-1], right[floor_x:x][::-1])
        return y - back_y, x - back_x, same, total

    y0, x0, same, total = begin()
    for ny, nx in zip(ys.tolist(), xs.tolist()):
        if ny < y or nx < x:  # the link overlaps what is aligned; its rest must lie on the same diagonal
            if ny - y == nx - x and ny + SEED > y:
                new = ny + SEED - y
                same, total, y, x = same + new, total + new, y + new, x + new
            continue
        equal, words = _gap(left[y:ny], right[x:nx]), max(ny - y, nx - x)
        if words - equal > BREAK:
            more_y, more_x, gained, more = _reach(left[y:ny], right[x:nx])
            found.append((y0, y + more_y, x0, x + more_x, same + gained, total + more))
            floor_y, floor_x = y + more_y, x + more_x
            y, x = ny, nx
            y0, x0, same, total = begin()
            equal = words = 0
        same, total = same + equal + SEED, total + words + SEED
        y, x = ny + SEED, nx + SEED
    more_y, more_x, gained, more = _reach(left[y:], right[x:])
    return [*found, (y0, y + more_y, x0, x + more_x, same + gained, total + more)]


def _reach_many(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, way: int) -> list[np.ndarray]:
    """``_reach`` of many extensions: from ``words[a]`` and ``words[b]`` on, ``n`` and ``m`` words at most, forwards or (``way`` -1) backwards."""
    i, j, same, total = (np.zeros(len(a), np.int64) for _ in range(4))
    todo = np.arange(len(a))
    look, last = np.arange(LOOK), len(words) - 1

    def equal(of: np.ndarray, di: int, dj: int, steps: np.ndarray, inside: np.ndarray) -> np.ndarray:
        left = words[np.clip((a[of] + way * (i[of] + di))[:, None] + way * steps, 0, last)]
        right = words[np.clip((b[of] + way * (j[of] + dj))[:, None] + way * steps, 0, last)]
        return (left == right) & inside

    while len(todo):
        # as in _straight; the first place behind an end falls
        room = np.minimum(n[todo] - i[todo], m[todo] - j[todo])
        steps = np.arange(int(room.max()) + 1)
        inside = steps < room[:, None]
        hit = equal(todo, 0, 0, steps, inside)
        score = np.cumsum(np.where(inside, np.where(hit, MATCH, MISMATCH), -(DROP + 1)), axis=1)
        fell = np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > DROP
        score[steps >= fell.argmax(axis=1)[:, None]] = -1
        best, rows = score.argmax(axis=1), np.arange(len(todo))
        gains = np.where(score[rows, best] > 0, best + 1, 0)
        i[todo] += gains
        j[todo] += gains
        total[todo] += gains
        same[todo] += np.where(gains > 0, np.cumsum(hit, axis=1)[rows, best], 0)
        on, left = [], todo
        for da, db in SHIFTS:
            room = np.minimum(n[left] - i[left] - da, m[left] - j[left] - db)
            able = np.flatnonzero(room >= LOOK_NEED)
            some = left[able]
            goes = some[equal(some, da, db, look, look < room[able][:, None]).sum(axis=1) >= LOOK_NEED]
            i[goes] += da
            j[goes] += db
            total[goes] += max(da, db)
            on.append(goes)
            left = left[~np.isin(left, goes)] if len(goes) else left
        todo = np.sort(np.concatenate(on))
    return [i, j, same, total]


_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists, and where each begins, with the end of the last."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))].astype(np.int64)


def _aligned_groups(rows: pa.Table) -> Iterator[list[np.ndarray]]:
    """The columns of the passages of whole groups: tiles of their own text (side 0), of its sources (1) and the chains between them (2)."""
    side = rows.column("side").to_numpy()
    chains = rows.filter(pa.array(side == 2))
    if not chains.num_rows:
        return
    tiles = rows.filter(pa.array(side < 2))
    number = lambda t, name: t.column(name).to_numpy()
    doc, part, of = (number(rows, c) for c in ("doc", "part", "of"))
    group = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])
    names, of = np.unique(of, return_inverse=True)
    # the texts of each group have numbers that rise with the rows, and so have their tiles
    text = (2 * group + np.minimum(side, 1)) * len(names) + of
    is_tile = side < 2
    tile = number(tiles, "tile").astype(np.int64)
    span = int(tile.max()) + 2
    key, owner = text[is_tile] * span + tile, text[is_tile]
    data = tiles.column("words").combine_chunks()
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    offsets = np.r_[0, np.cumsum(sizes)]
    words = np.frombuffer(b"".join(data.to_pylist()), np.uint32)

    doc, ref = number(chains, "doc"), number(chains, "of")
    ys, cuts = _lists(chains.column("ys").combine_chunks())
    xs, _ = _lists(chains.column("xs").combine_chunks())
    first, end = cuts[:-1], cuts[1:] - 1

    def place(texts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each chain: its words' first index less their place, and where its stretch begins and ends."""
        low = np.maximum(at[first] - MARGIN, 0)
        row = np.searchsorted(key, texts * span + low // TILE)
        begin = offsets[row] + low % TILE
        stop = np.minimum(begin + at[end] + SEED + MARGIN - low, offsets[np.searchsorted(owner, texts, "right")])
        return begin - low, begin, stop, low

    own = text[~is_tile]
    base = (2 * group[~is_tile]) * len(names)
    left, left_begin, left_stop, low_y = place(base + np.searchsorted(names, doc), ys)
    right, right_begin, right_stop, low_x = place(own, xs)

    # between two links of a chain: nothing, or a gap
    chain_of = np.repeat(np.arange(len(doc)), np.diff(cuts))
    step = np.flatnonzero(chain_of[1:] == chain_of[:-1])
    dy, dx, of_step = ys[step + 1] - ys[step], xs[step + 1] - xs[step], chain_of[step]
    overlap = (dy == dx) & (dy > 0) & (dy < SEED)
    odd = ~overlap & ((dy < SEED) | (dx < SEED))
    n, m = np.where(overlap, 0, dy - SEED), np.where(overlap, 0, dx - SEED)
    a, b = left[of_step] + ys[step] + SEED, right[of_step] + xs[step] + SEED
    equal = np.zeros(len(step), np.int64)
    even = np.flatnonzero((n == m) & (n > 0) & ~odd)
    if len(even):
        runs = n[even]
        begins = np.cumsum(runs) - runs
        inner = np.arange(int(runs.sum())) - np.repeat(begins, runs)
        equal[even] = np.add.reduceat(words[np.repeat(a[even], runs) + inner] == words[np.repeat(b[even], runs) + inner], begins, dtype=np.int64)
    for k in np.flatnonzero(~odd & (n > 0) & (m > 0) & (np.abs(n - m) <= BREAK) & ((n != m) | (equal < n - 1))).tolist():
        equal[k] = _gap(words[a[k] : a[k] + n[k]], words[b[k] : b[k] + m[k]])
    most = np.maximum(n, m)
    plain = np.ones(len(doc), bool)
    plain[of_step[odd | (most - equal > BREAK)]] = False
    same, total = (np.bincount(of_step, np.where(overlap, dy, SEED + c), len(doc)).astype(np.int64) + SEED for c in (equal, most))

    found = []
    k = np.flatnonzero(plain)
    if len(k):
        y, x = left[k] + ys[first[k]], right[k] + xs[first[k]]
        back_y, back_x, back_same, back = _reach_many(words, y - 1, x - 1, y - left_begin[k], x - right_begin[k], -1)
        y, x = left[k] + ys[end[k]] + SEED, right[k] + xs[end[k]] + SEED
        more_y, more_x, more_same, more = _reach_many(words, y, x, left_stop[k] - y, right_stop[k] - x, 1)
        found.append([k, ys[first[k]] - back_y, ys[end[k]] + SEED + more_y, xs[first[k]] - back_x, xs[end[k]] + SEED + more_x, same[k] + back_same + more_same, total[k] + back + more])
    for k in np.flatnonzero(~plain).tolist():
        lo, hi = cuts[k], cuts[k + 1]
        pieces = align(words[left_begin[k] : left_stop[k]], words[right_begin[k] : right_stop[k]], ys[lo:hi] - low_y[k], xs[lo:hi] - low_x[k])
        shift = np.array([low_y[k], low_y[k], low_x[k], low_x[k], 0, 0])
        found.append([np.full(len(pieces), k), *(np.array(pieces) + shift).T])
    k, y0, y1, x0, x1, same, total = (np.concatenate(c) for c in zip(*found))
    doc, ref = doc[k], ref[k]
    y0 = np.where((doc == ref) & (x1 < y1), np.maximum(y0, x1), y0)  # a text's later half may not reach into its own source
    ok = (y1 - y0 >= CHAIN_WORDS) & (total > 0)
    ok[ok] = same[ok] / total[ok] >= SIMILARITY
    yield [doc[ok], y0[ok], y1[ok], ref[ok], x0[ok], x1[ok], same[ok], same[ok] / total[ok]]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of groups, some of them at a time."""
    held: list[pa.RecordBatch] = []

    def passages() -> Iterator[pa.RecordBatch]:
        for columns in _aligned_groups(pa.Table.from_batches(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _PIECE_TYPES)], ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start", "ref_end", "matched", "identity"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.flatnonzero((doc[1:] != doc[:-1]) | (part[1:] != part[:-1])) + 1
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (doc[0], part[0]):
            new = np.r_[0, new]
        if len(new):
            held.append(batch.slice(0, int(new[-1])))
            yield from passages()
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield from passages()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text's pieces those in stretches of MIN_WORDS or more, whatever their sources."""
    for group in grouped(batches, 1):
        starts, ends = group.column("start_word").to_numpy(), group.column("end_word").to_numpy()
        reach = np.maximum.accumulate(ends)
        begins = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1] + JOIN])
        stops = np.r_[begins[1:], len(starts)]
        edited = np.add.reduceat((group.column("identity").to_numpy() < 1).astype(np.int64), begins) > 0
        long = reach[stops - 1] - starts[begins] + np.where(edited, EDGE, 0) >= MIN_WORDS
        if long.any():
            yield from group.filter(pa.array(np.repeat(long, stops - begins))).to_batches()


def _unique(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each doc_id: of rows that repeat one, the smallest text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return checkpoint(rows.groupBy("doc_id").agg(F.min("text").alias("text")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row for each passage of a text that an earlier text, or the same text earlier, has too.

    Columns: doc_id, start_word, end_word (from 0, end exclusive), the same of the
    source (ref_doc_id, ref_start, ref_end), matched words and identity.  Earlier
    means a smaller doc_id.  One source of a seed is its first document, so a
    passage of many copies is linked to few sources and none of its later copies is
    missed; the other is its nearest earlier document, so that a passage edited from
    version to version is held against the version before.  Then all earlier documents
    of a seed are sources, except those that the passages found have brought together
    with it there; a passage is in one class with its sources.  Where the words of one
    passage stand in several documents, it has a row for each piece, and together they
    have ``MIN_WORDS`` or more.  Null and empty texts have no passages; rows without a
    doc_id take no part; of rows that repeat a doc_id the smallest text counts.
    """
    rows, bits = _unique(docs), _bits(docs.sparkSession)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _seeded(batches, bits)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked_and_many(batches, bits)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bundles(_placed(batches), bits, _PLACED)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bundles(_apart(batches), bits, _LINKED)

    links = checkpoint(_dealt(rows.mapInArrow(seeded, _BUNDLES)).mapInArrow(linked, _BUNDLES))
    release(docs.sparkSession)  # the shuffle of the seeds
    found = checkpoint(_dealt(links).mapInArrow(_chained, _CHAIN_TYPES))
    del links
    release(docs.sparkSession)  # the links and their shuffle
    pieces = checkpoint(_pieces(rows, found.where("hs is null").select(_CHAINS)))
    release(docs.sparkSession)  # the shuffles of the texts and tiles
    spans = pieces.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start_word", "end_word", "ref_doc_id", "ref_start", "ref_end")).alias("spans"))
    many = found.where("hs is not null").select("doc", "ys", "hs", "ss", "ws")
    many = many.join(spans.hint("merge"), many["doc"] == spans["of"], "left").select("doc", "ys", "hs", "ss", "ws", "spans")
    links = _dealt(_dealt(many.mapInArrow(placed, _BUNDLES)).mapInArrow(apart, _BUNDLES))
    chains = checkpoint(links.mapInArrow(_chained, _CHAIN_TYPES).select(_CHAINS))
    del found, spans, many, links
    release(docs.sparkSession)
    if not chains.isEmpty():
        pieces = pieces.unionByName(_pieces(rows, chains)).distinct()
    return _in_whole(pieces)


_PASSAGES = "doc_id long, start_word int, end_word int, ref_doc_id long, ref_start int, ref_end int, matched int, identity double"


def _in_whole(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("doc_id").sortWithinPartitions("doc_id", "start_word", "end_word").mapInArrow(_whole, _PASSAGES)


def _pieces(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """The aligned pieces of ``chains`` between texts of ``rows``."""
    # the words of both sides, in tiles; a group is what begins in one stretch of a text, so it is bounded
    tiles_of = lambda lo, hi: F.sequence(F.floor(F.greatest(F.col(lo) - MARGIN, F.lit(0)) / TILE).cast("int"), F.floor((F.col(hi) + MARGIN - 1) / TILE).cast("int"))
    grouping = ["doc", F.floor(F.col("y0") / GROUP_WORDS).cast("long").alias("part")]
    own = chains.select(*grouping, F.lit(0).alias("side"), F.col("doc").alias("of"), F.explode(tiles_of("y0", "y1")).alias("tile"))
    other = chains.select(*grouping, F.lit(1).alias("side"), F.col("ref").alias("of"), F.explode(tiles_of("x0", "x1")).alias("tile"))
    needs = own.unionByName(other).distinct()
    involved = checkpoint(chains.select(F.col("doc").alias("doc_id")).unionByName(chains.select(F.col("ref").alias("doc_id"))).distinct())
    tiles = rows.join(involved.hint("merge"), "doc_id", "left_semi").mapInArrow(_tiles, "doc long, tile int, words binary").select(F.col("doc").alias("of"), "tile", "words")
    none = F.lit(None).cast("array<int>")
    filled = needs.join(tiles.hint("merge"), ["of", "tile"]).select("doc", "part", "side", "of", "tile", "words", none.alias("ys"), none.alias("xs"))
    filled = filled.unionByName(chains.select(*grouping, F.lit(2).alias("side"), F.col("ref").alias("of"), F.col("y0").alias("tile"), F.lit(None).cast("binary").alias("words"), "ys", "xs"))
    filled = filled.repartition("doc", "part").sortWithinPartitions("doc", "part", "side", "of", "tile")
    return filled.mapInArrow(_aligned, _PASSAGES)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space behind each."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = ~_SPACE[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)) == 1)
    edge = lambda k: int(starts[k]) if k < len(starts) else len(raw)
    out, at = [], 0
    for lo, hi in sorted(spans):
        lo, hi = edge(lo), edge(hi)
        if lo > at:
            out.append(raw[at:lo])
        at = max(at, hi)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def drop_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the later copies of repeated passages; texts may become empty, rows stay.

    ``n_chars``, if there, is brought up to date.  Rows that ``repeated_passages``
    leaves out stay as they are.
    """
    passages = repeated_passages(docs)
    spans = checkpoint(passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("spans")))
    # the hash tells the indexed text from others under the same doc_id
    indexed = _unique(docs).select("doc_id", F.xxhash64("text").alias("hash"))
    spans = checkpoint(spans.join(indexed.hint("merge"), "doc_id").select(F.col("doc_id").alias("id"), "hash", "spans"))
    rows = packed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.col("text").cast("string"))).join(spans.hint("merge"), ["id", "hash"], "left").select("row", "spans")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            fields = row.flatten()
            texts = [t if not s or t is None else cut(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip((v.as_py() for v in fields[at]), (v.as_py() for v in batch.column(1)))]
            fields[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], ["row"])

    rows = rows.mapInArrow(run, T.StructType([rows.schema["row"]]))
    changed = {"n_chars": F.length("row.text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rows.select(*unpacked(rows, docs.columns, **changed))


def op8(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
