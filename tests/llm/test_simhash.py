from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelattice.llm import simhash
from tracelattice.llm.components import connected_components

from .data import corpus, documents


def plain(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abÀ é\x85\xa0\n\tZ", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def roots(values: list[int], distance: int) -> list[int]:
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize(("distance", "block"), [(3, 1024), (3, 2), (1, 3), (0, 1024)])
def test_links_equal_brute_force(spark, distance, block):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        w = v
        for _ in range(3):  # chains of near fingerprints
            for b in rng.sample(range(64), rng.randint(1, 4)):
                w ^= 1 << b
            values.append(w)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, block)
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == roots(values, distance)


def test_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.int64).view(np.uint64) for _ in range(2))
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)]).astype(int)
    bound = np.abs(counts(a) - counts(b)).sum(0)
    assert (bound == np.bitwise_count(simhash.thermometer(a) ^ simhash.thermometer(b))).all()
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_classes_equal_brute_force(spark):
    texts = corpus()
    found = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    values = [plain(t) for t in texts]
    assert [found[i]["component_id"] for i in range(len(texts))] == roots(values, 3)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(3, 3), (None, 4), (7, 10)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_query_columns(spark, tmp_path):
    documents(spark, corpus(n=8)).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = simhash.op9(spark, f"file://{tmp_path}")
    assert found.where(F.length("fingerprint") != 16).count() == 0
