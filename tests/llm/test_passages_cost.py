"""Seeds and links are dealt out in bundles, and plain chains are aligned together."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tracelattice.llm import substring

from .data import documents


def test_bundles_hold_all_rows():
    rng = np.random.default_rng(5)
    ends = np.iinfo(np.int64)
    rows = [[rng.integers(ends.min, ends.max, n), rng.integers(-3, 300, n), np.arange(n), np.where(np.arange(n) % 3, ends.min, ends.max), np.full(n, -7)] for n in (0, 1, 700, 40)]
    for bits in (1, 8, 16):
        batch = pa.Table.from_batches(list(substring._bundles(iter(rows), bits, substring._MANY))).sort_by([("bucket", "ascending"), ("kind", "ascending")]).combine_chunks()
        for size in (1, 3, 10_000):
            found = list(substring._opened(iter(batch.to_batches(max_chunksize=size)), (0, 1)))
            assert all(kind == substring._MANY for kind, _ in found)
            assert len(found) == len(batch.column("bucket").unique())
            for _, columns in found:
                assert (np.diff(columns[0].astype(object)) >= 0).all()
            assert sorted(r for _, columns in found for r in zip(*(c.tolist() for c in columns))) == sorted(r for columns in rows for r in zip(*(c.tolist() for c in columns)))


def test_seeds_take_little_disk(spark):
    """Shuffled bytes for each seed of texts that share none; about half are those of the texts themselves (in all 62.7 a seed, 70.8 as rows)."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(400)) for _ in range(1500)]
    docs = documents(spark, texts)
    count = sum(len(substring.seeds(substring.word_hashes(t))[0]) for t in texts)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert substring.repeated_passages(docs).count() == 0
    assert written() - before < 66 * count


def groups(rng):
    """Rows of ``_aligned``, and the chains in them: (doc, ref, places in both, words of both)."""
    rows, chains = [], []
    for doc in range(10, 40):
        own = rng.integers(0, 1 << 32, rng.integers(200, 900), dtype=np.uint32)
        sources = {}
        for ref in sorted(rng.choice(doc, 3, replace=False).tolist()):
            lo = int(rng.integers(0, 100))
            passage = own[lo : lo + int(rng.integers(60, 100))].tolist()
            starts = [k for k in range(0, len(passage) - 4, 9)]
            for k in rng.choice(len(passage), 6, replace=False).tolist() if doc % 3 else []:
                passage[k] = int(rng.integers(0, 1 << 32))
            before = int(rng.integers(0, 300))
            other = np.r_[rng.integers(0, 1 << 32, before, dtype=np.uint32), np.array(passage, np.uint32), rng.integers(0, 1 << 32, int(rng.integers(0, 200)), dtype=np.uint32)]
            ys = [lo + k for k in starts if (own[lo + k : lo + k + 4] == other[before + k : before + k + 4]).all()]
            if ys:
                sources[ref] = (other, ys, [y - lo + before for y in ys])
        tiles = lambda words, lo, hi: [(k, words[k * substring.TILE : (k + 1) * substring.TILE].tobytes()) for k in range(max(0, lo - substring.MARGIN) // substring.TILE, (hi + substring.MARGIN - 1) // substring.TILE + 1) if k * substring.TILE < len(words)]
        if not sources:
            continue
        mine = {t for _, ys, _ in sources.values() for t in tiles(own, ys[0], ys[-1] + 4)}
        rows += [(doc, 0, 0, doc, *t, None, None) for t in sorted(mine)]
        rows += [(doc, 0, 1, ref, *t, None, None) for ref, (other, _, xs) in sources.items() for t in tiles(other, xs[0], xs[-1] + 4)]
        rows += [(doc, 0, 2, ref, ys[0], None, ys, xs) for ref, (_, ys, xs) in sources.items()]
        chains += [(doc, ref, np.array(ys), np.array(xs), own, other) for ref, (other, ys, xs) in sources.items()]
    schema = pa.schema([("doc", pa.int64()), ("part", pa.int64()), ("side", pa.int32()), ("of", pa.int64()), ("tile", pa.int32()), ("words", pa.binary()), ("ys", pa.list_(pa.int32())), ("xs", pa.list_(pa.int32()))])
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema), chains


def test_plain_chains_are_aligned_together(monkeypatch):
    """Chains without a break need no call each, and get the passages of ``align``, wherever the batches are cut."""
    rows, chains = groups(np.random.default_rng(7))
    expected = []
    for doc, ref, ys, xs, own, other in chains:
        lo_y, lo_x = max(0, int(ys[0]) - substring.MARGIN), max(0, int(xs[0]) - substring.MARGIN)
        found = substring.align(own[lo_y : int(ys[-1]) + 4 + substring.MARGIN], other[lo_x : int(xs[-1]) + 4 + substring.MARGIN], ys - lo_y, xs - lo_x)
        assert len(found) == 1
        y0, y1, x0, x1, same, total = found[0]
        if y1 - y0 >= substring.CHAIN_WORDS and same / total >= substring.SIMILARITY:
            expected.append((doc, y0 + lo_y, y1 + lo_y, ref, x0 + lo_x, x1 + lo_x, same, same / total))
    assert len(expected) > 60
    monkeypatch.setattr(substring, "align", None)
    for size in (1, 7, 10_000):
        assert sorted(tuple(r.values()) for b in substring._aligned(iter(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()) == sorted(expected)


def test_many_extensions_equal_single_ones():
    rng = np.random.default_rng(8)
    for _ in range(20):
        words = rng.integers(0, 3 if _ % 2 else 9, 4000, dtype=np.uint32)
        words[2000:] = np.where(rng.random(2000) < 0.8, words[:2000], words[2000:])
        a, n, m = rng.integers(64, 1900, 300), rng.integers(0, 65, 300), rng.integers(0, 65, 300)
        b = a + 2000 + rng.integers(-2, 3, 300)
        for way in (1, -1):
            found = np.array(substring._reach_many(words, a, b, n, m, way)).T
            for k in range(300):
                left, right = (words[s : s + c] if way > 0 else words[s - c + 1 : s + 1][::-1] for s, c in ((a[k], n[k]), (b[k], m[k])))
                assert tuple(found[k].tolist()) == substring._reach(left, right)


def test_breaks_in_chains_of_groups():
    """A chain over more words without a partner than BREAK gives two passages."""
    rng = random.Random(9)
    words = lambda n: np.array([rng.randrange(1 << 32) for _ in range(n)], np.uint32)
    one, two = words(50), words(50)
    own, other = np.r_[one, two], np.r_[one, words(20), two]
    table = pa.table({"doc": [5] * 3, "part": [0] * 3, "side": pa.array([0, 1, 2], pa.int32()), "of": [5, 3, 3], "tile": pa.array([0, 0, 10], pa.int32()), "words": pa.array([own.tobytes(), other.tobytes(), None], pa.binary()), "ys": pa.array([None, None, [10, 70]], pa.list_(pa.int32())), "xs": pa.array([None, None, [10, 90]], pa.list_(pa.int32()))})
    found = [tuple(r.values()) for b in substring._aligned(iter(table.to_batches())) for r in b.to_pylist()]
    assert found == [(5, 0, 50, 3, 0, 50, 50, 1.0), (5, 50, 100, 3, 70, 120, 50, 1.0)]


def test_pairs_of_a_seed_in_several_blocks(monkeypatch):
    """Occurrences are compared block by block, with the same links whatever the blocks."""
    rng = np.random.default_rng(10)
    n = 60
    sides = np.where(rng.random(n) < 0.5, 0x1234567812345678, rng.integers(1, 1 << 60, n))
    rows = [np.full(n, 77), np.arange(n), rng.integers(0, 50, n), sides, sides, np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)]
    found = []
    for size in (1, 130, 1 << 16):
        monkeypatch.setattr(substring, "COMPARED", size)
        found.append(sorted(r for c in substring._apart(substring._bundles(iter([rows]), 8, substring._PLACED)) for r in zip(*(x.tolist() for x in c))))
    assert found[0] == found[1] == found[2]
    same = np.flatnonzero(sides == 0x1234567812345678)
    assert len(found[0]) >= len(same) * (len(same) - 1) // 2 > 100
