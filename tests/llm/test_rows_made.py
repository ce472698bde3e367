"""Texts that are like each other, yet not near copies, cost rows in proportion to their number, not to their pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tracelattice.llm import jaccard

from .data import documents, prose


def made(spark, since: int) -> int:
    """The most rows that a function over batches made in the queries after ``since``."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(runs.size()):
        number = runs.apply(k).executionId()
        if number > since and "MapInArrow" in runs.apply(k).physicalPlanDescription():
            values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
            for n in (nodes.apply(i) for i in range(nodes.size())):
                if "MapInArrow" in n.name():
                    for metric in (n.metrics().apply(i) for i in range(n.metrics().size())):
                        if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                            most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_texts_apart_make_no_row_for_each_pair(spark):
    rng = random.Random(6)
    base, texts = prose(rng, 100).split(), []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(100), 3):
            words[at] = f"edit{rng.random()}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    near = [(j, i) for i, s in enumerate(sets) for j in range(i) if 10 * len(s & sets[j]) >= 8 * len(s | sets[j])]
    root = list(range(400))
    for a, b in near:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = max((runs.apply(k).executionId() for k in range(runs.size())), default=-1)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "").collect()}
    assert kept == set(root)
    assert 0 < made(spark, since) <= 400 * 96


def joined(n: int, links) -> list[int]:
    root = list(range(n))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def test_sketches_and_blocks_join_what_links_reach():
    """Sets on both sides of a sketch's length; whole and in two sides of a block."""
    rng = np.random.default_rng(8)
    sets = []
    for n in (3, 200, 240, 256, 300, 500, 520, 900):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(12):
            keep = base[rng.random(n) < rng.uniform(0.75, 1)]
            sets.append(np.unique(np.r_[keep, base[:1], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
    n = len(sets)
    near = [(j, i) for i, s in enumerate(sets) for j in range(i) if 10 * (both := len(np.intersect1d(s, sets[j]))) >= 8 * (len(s) + len(sets[j]) - both)]
    assert joined(n, near) != list(range(n)) and len(set(joined(n, near))) > 10
    numbers, side = np.arange(n), rng.integers(0, 2, n)
    assert joined(n, jaccard._joining(sets, numbers, None)) == joined(n, near)
    across = [(a, b) for a, b in near if side[a] != side[b]]
    assert joined(n, jaccard._joining(sets, numbers, side)) == joined(n, across)
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(numbers), pa.array([len(s) for s in sets], pa.int64()), pa.array(numbers), pa.array([jaccard.sketch(s) for s in sets], pa.binary())], ["h", "node", "size", "root", "sketch"])
    links = [x for batch in jaccard._gathered(iter([rows])) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    clusters = joined(n, links)
    assert len(links) < n and all(clusters[a] == clusters[b] for a, b in near)
    lone = {k for batch in jaccard._live(iter([rows.select(["h", "node", "size", "root"])])) for k in batch.column(1).to_pylist()}
    assert {k for pair in near for k in pair} <= lone
