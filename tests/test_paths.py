from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelattice.operators import graph, paths
from tracelattice.plans.pipeline import address_text, warts_graph, yarrp_graph
from tracelattice.sources import yarrp

SCAN = """# comment
10.0.0.1 1 2 11 0 1 10.0.1.1 5 6 7
10.0.0.1 1 2 11 0 2 10.0.1.2 5 6 7
10.0.0.2 1 2 11 0 1 10.0.1.1 5 6 7
10.0.0.1 1 2 11 0 6 10.0.1.3 5 6 7
10.0.0.2 1 2 11 0 5 10.0.1.3 5 6 7
10.0.0.2 1 2 11 0 5 10.0.1.3 5 6 7
10.0.0.2 1 2 11 0 6 10.0.1.2 5 6 7
"""


def scan(spark, text):
    return spark.createDataFrame([(v, "f", 0, i) for i, v in enumerate(text.splitlines())], "value string, file_name string, block_start long, line_no long")


def hops(spark, rows):
    return spark.createDataFrame(rows, "target long, ttl int, hop long, n int")


def test_scan_to_edges(spark):
    mapping, edges, most = yarrp_graph(yarrp.hops(scan(spark, SCAN)))
    names = {r["ip"]: r["node_id"] for r in address_text(mapping, "V4", False).collect()}
    assert names == {"10.0.0.1": 1, "10.0.1.1": 2, "10.0.1.2": 3, "10.0.0.2": 4, "10.0.1.3": 5}
    assert tuple(most.first()) == (5, 4)
    found = sorted((r["from"], r["to"]) for r in edges.collect())
    # unknown nodes are numbered by anchor and depth: (2,1) (2,2) (3,1) (3,2)
    expected = [(0, 2), (2, 3), (3, -3), (-3, -4), (-4, 5), (0, 2), (2, -1), (-1, -2), (-2, 5), (5, 5), (5, 3)]
    assert found == sorted(expected)
    assert graph.distinct_edges(edges).count() == 10


@pytest.mark.parametrize(("ttl", "reference", "full"), [(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 2), (6, 4, 5)])
def test_gap_rule(spark, ttl, reference, full):
    rows = hops(spark, [(1, ttl, 7, 0)])
    for mode, n in (("reference", reference), ("full", full)):
        walked = paths.steps(rows, ["target"], ["ttl", "n"], F.lit(0).cast("long"), mode)
        assert walked.first()["k"] == n
        assert paths.expand(walked).count() == n + 1


def test_ties_and_self_loops(spark):
    edges = paths.path_edges(hops(spark, [(1, 3, 8, 0), (1, 3, 9, 1), (1, 4, 9, 2)]), ["n"])
    assert sorted(tuple(r) for r in edges.collect()) == [(0, 0, 0, 1), (0, 1, 8, 0), (8, 0, 9, 0), (9, 0, 9, 0)]


def test_unknown_nodes_equal_the_sequential_memory(spark):
    rng = random.Random(5)
    rows = [(t, rng.randint(0, 12), rng.randint(1, 9), i) for t in range(60) for i in range(rng.randint(0, 6))]
    walked = paths.steps(hops(spark, rows), ["target"], ["ttl", "n"], F.lit(0).cast("long"))
    found = sorted(tuple(r) for r in paths.expand(walked).collect())
    memory, expected, fresh = {}, [], 0
    for t in sorted({r[0] for r in rows}):
        node, before = 0, 0
        for _, ttl, hop, _ in sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], r[3])):
            for _ in range(max(0, ttl - before - 2)):
                if node not in memory:
                    fresh -= 1
                    memory[node] = fresh
                expected.append((node, memory[node]))
                node = memory[node]
            expected.append((node, hop))
            node, before = hop, ttl
    key = {n: (n, 0) for n in range(10)}
    for a, b in sorted(memory.items(), key=lambda x: -x[1]):
        key[b] = (key[a][0], key[a][1] + 1)
    assert found == sorted((*key[a], *key[b]) for a, b in expected)
    assert paths.unknown_nodes(walked).count() == -fresh


def test_records_with_their_own_sources(spark):
    x, y, z, s, r = (bytes([10, 0, 0, i]) for i in range(1, 6))
    hop = lambda pos, ttl, kind, addr: {"pos": pos, "probe_ttl": ttl, "kind": kind, "addr": addr}
    rows = [
        ("f", 0, "traceroute", {"kind": "ipv4", "addr": s}, [hop(0, 1, "ipv4", x), hop(1, 4, "ipv4", y), hop(2, 5, "firewire", b"12345678"), hop(3, 7, "ipv4", z), hop(4, 6, "ipv4", y)]),
        ("f", 1, "traceroute", {"kind": "ipv4", "addr": r}, [hop(0, 3, "ipv4", x)]),
    ]
    from tracelattice import schemas

    mapping, edges, most = warts_graph(spark.createDataFrame(rows, schemas.WARTS_RECORDS))
    assert {q["ip"]: q["node_id"] for q in address_text(mapping, "V4", True).collect()} == {"10.0.0.4": 0, "10.0.0.1": 1, "10.0.0.2": 2, "10.0.0.3": 3, "10.0.0.5": 4}
    assert tuple(most.first()) == (4, 3)
    names = {(1, 1): -1, (2, 1): -2, (4, 1): -3}
    assert sorted((q["from"], q["to"]) for q in edges.collect()) == sorted([(0, 1), (1, names[1, 1]), (names[1, 1], 2), (2, names[2, 1]), (names[2, 1], 3), (3, 2), (4, names[4, 1]), (names[4, 1], 1)])


def test_empty_input(spark):
    mapping, edges, most = yarrp_graph(yarrp.hops(scan(spark, "")))
    assert mapping.count() == edges.count() == 0
    assert tuple(most.first()) == (0, 0)
