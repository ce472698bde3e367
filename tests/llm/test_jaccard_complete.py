"""No pair of 0.8 is missed, however many other texts hold the shingles of its prefix."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tracelattice.llm import jaccard

from .data import documents


def test_pairs_among_many_holders(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    firsts, seconds, others = [], [], []
    for _ in range(12):
        words = [word() for _ in range(44)]  # 40 shingles
        firsts.append(" ".join(words))
        seconds.append(" ".join(words[4:] + [word() for _ in range(4)]))  # 36 of 44
        for k in range(40):  # texts of like size that have one shingle of the pair each
            others += [" ".join([word() for _ in range(18)] + words[k : k + 5] + [word() for _ in range(21)]) for _ in range(12)]
    texts = firsts + others + seconds
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "").collect()}
    assert kept == set(range(len(firsts) + len(others)))


def test_prefixes_share_a_shingle_under_any_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        own = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        other = np.unique(np.r_[own[: -(n // 12) or None], rng.integers(0, 1 << 60, n // 12, dtype=np.uint64)])
        both = len(np.intersect1d(own, other))
        hashes = np.unique(rng.choice(np.union1d(own, other), n // 2 + 1))
        counts = rng.integers(3, 9, len(hashes))
        if 10 * both >= 8 * (len(own) + len(other) - both):
            assert len(np.intersect1d(jaccard.prefix(own, hashes, counts), jaccard.prefix(other, hashes, counts)))
