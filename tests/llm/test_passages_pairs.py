"""Pairs of a seed's occurrences: those with too few words around are not compared, and the others as one by one."""

from __future__ import annotations

import numpy as np

from tracelattice.llm import substring


def links(sides, wide):
    n = len(sides)
    rows = [np.full(n, 77), np.arange(n), np.arange(n), sides.view(np.int64), wide.view(np.int64), *(np.zeros(n, int) for _ in range(3))]
    return sorted(r for c in substring._apart(substring._bundles(iter([rows]), 8, substring._PLACED)) for r in zip(*(x.tolist() for x in c)))


def packed(fours):
    return sum(fours[:, k].astype(np.uint64) << np.uint64(4 * k) for k in range(16))


def test_occurrences_with_few_words_around(monkeypatch):
    """Ten equal words before each and none behind can't make 20, so no pair is looked at."""
    n, seen = 500, []
    before = np.zeros((n, 32), np.int64)
    before[:, 6:16] = np.arange(1, 11)
    marks = substring._marks
    monkeypatch.setattr(substring, "_marks", lambda x: (seen.append(x.size), marks(x))[1])
    assert links(packed(before[:, 8:24]), packed(np.c_[before[:, :8], before[:, 24:]])) == []
    assert sum(seen) < 20 * n


def test_pairs_equal_brute_force():
    rng = np.random.default_rng(14)
    for variety in (2, 15):
        n = 90
        fours = rng.integers(1, variety + 1, (n, 32))
        fours[: n // 2] = np.where(rng.random((n // 2, 32)) < 0.8, fours[0], fours[: n // 2])
        for k, (lo, hi) in enumerate(rng.integers(0, 17, (n, 2)).tolist()):
            if k % 3:  # texts that begin or end near
                fours[k, : max(0, lo - 4)], fours[k, 32 - max(0, hi - 4) :] = 0, 0
        expected = []
        for late in range(n):
            for early in range(late):
                a, b = fours[late], fours[early]
                agree = sum(a[k] == b[k] > 0 for k in range(8, 24))
                beside = lambda k, ends: any(a[k] == b[j] > 0 for j in (k - 1, k, k + 1) if j in ends)
                around = sum(beside(k, ends) for ends in (range(16), range(16, 32)) for k in ends)
                if agree >= substring.NEAR and around >= substring.WIDE_NEAR:
                    expected.append((late, early, late, early, agree))
        found = links(packed(fours[:, 8:24]), packed(np.c_[fours[:, :8], fours[:, 24:]]))
        # the first occurrence is the largest class, against which the later ones are held
        assert found == sorted(expected) and len(found) > 50
