from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tracelattice.llm import simhash

from .data import documents, prose


def plain(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_equal_brute_force(spark):
    """Single copies and chains of edits: of each group of texts that links of 0.8 reach, the first stays."""
    rng = random.Random(4)
    texts = []
    for i in range(30):
        words = prose(rng, rng.randint(3, 200)).split()
        texts.append(" ".join(words))
        for _ in range(i % 5):
            for _ in range(max(1, len(words) // 80)):
                words[rng.randrange(len(words))] = f"edit{rng.random()}"
            texts.append(" ".join(words))
    texts += texts[:5]
    rng.shuffle(texts)
    sets = [plain(t) for t in texts]
    root = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 10 * len(s & sets[j]) >= 8 * len(s | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    found = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "").collect()}
    assert len(set(root)) < len(texts) - 20
    assert found == set(root)


def test_links_of_fingerprints_alone(spark):
    """Texts that share no prefix shingle's holder are still held against each other where their fingerprints are near."""
    rng = random.Random(9)
    texts = [prose(rng, 400) for _ in range(20)]
    texts += [f"{t} tail" for t in texts]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    own = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "node long, fp long")
    found = {(max(r), min(r)) for r in simhash.fingerprint_candidates(own).collect()}
    near = {(i + 20, i) for i in range(20) if (prints[i] ^ prints[i + 20]).bit_count() <= 3}
    assert len(near) > 10
    assert found == near
