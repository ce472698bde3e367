from __future__ import annotations

import random
from collections import deque

import pytest

from tracelattice.operators import betweenness as bt
from tracelattice.operators import degree, graph, ids

DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (1, 2), (3, 3)]
MICRO = [(0, 2), (2, 3), (3, -1), (-1, -2), (-2, 5), (2, -3), (-3, -4), (-4, 5), (5, 5), (5, 3)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "`from` long, `to` long")


def brute(edges, reference):
    edges = sorted(set(edges))
    following = {}
    for a, b in edges:
        following.setdefault(a, []).append(b)
    score = {}
    for s in following:
        order, preds, sigma, dist = [], {}, {s: 1}, {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in following.get(v, []):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
                    preds.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in preds.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] = score.get(w, 0) + delta[w] * (len(preds[w]) if reference else 1)
    return {k: round(v, 6) for k, v in score.items() if v}


def scores(df):
    return {r["node_id"]: round(r["betweenness"], 6) for r in df.collect()}


@pytest.mark.parametrize("method", ["tasks", "levels"])
def test_betweenness(spark, method):
    assert scores(bt.betweenness(frame(spark, DIAMOND), "reference", method)) == {1: 1.5, 2: 1.5, 3: 8.0, 4: 4.0}
    assert scores(bt.betweenness(frame(spark, DIAMOND), "brandes", method)) == {1: 1.5, 2: 1.5, 3: 6.0, 4: 4.0}
    assert scores(bt.betweenness(frame(spark, MICRO), "reference", method)) == {-4: 6, -3: 4, -2: 3, -1: 7, 2: 6, 3: 11, 5: 9}
    assert scores(bt.betweenness(frame(spark, []), "reference", method)) == {}


def test_betweenness_on_random_graphs(spark):
    rng = random.Random(3)
    edges = sorted({(g * 100 + rng.randint(0, 12), g * 100 + rng.randint(0, 12)) for g in range(20) for _ in range(rng.randint(5, 30))})
    for variant in bt.VARIANTS:
        assert scores(bt.betweenness(frame(spark, edges), variant, "tasks")) == brute(edges, variant == "reference")
    assert scores(bt.betweenness(frame(spark, edges[:120]), "reference", "levels")) == brute(edges[:120], True)


def test_resume(spark, tmp_path):
    folder = f"file://{tmp_path}/parts"
    full = scores(bt.betweenness_in_batches(frame(spark, MICRO), folder, 3))
    assert full == brute(MICRO, True)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("parts/batch=0/*")}
    for p in tmp_path.glob("parts/batch=1/*"):
        p.unlink()
    assert scores(bt.betweenness_in_batches(frame(spark, MICRO), folder, 3)) == full
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("parts/batch=0/*")} == before
    with pytest.raises(ValueError):
        bt.betweenness_in_batches(frame(spark, MICRO), folder, 0)


def walks(edges):
    edges = sorted(set(edges))
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    o, i = (lambda n: len(out.get(n, []))), (lambda n: len(into.get(n, [])))
    mean = lambda xs, f: sum(map(f, xs)) / len(xs) if xs else 0.0
    found = {}
    for n in {x for e in edges for x in e}:
        a, b = out.get(n, []), into.get(n, [])
        aa, bb = a + [y for x in a for y in out.get(x, [])], b + [y for x in b for y in into.get(x, [])]
        t = lambda x: o(x) + i(x)
        found[n] = (i(n), o(n), mean(b, i), mean(a, o), mean(a + b, t), mean(bb, i), mean(aa, o), mean(aa + bb, t))
    return found


def test_degree_equals_direct_walks(spark):
    rng = random.Random(1)
    for edges in (MICRO, DIAMOND, sorted({(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(120)})):
        found = {r[0]: tuple(r[1:]) for r in degree.degree_table(frame(spark, edges)).collect()}
        assert found == walks(edges)
        assert sum(v[0] for v in found.values()) == sum(v[1] for v in found.values()) == len(edges)
    assert degree.degree_table(frame(spark, [])).count() == 0


def test_micro_degree_values(spark):
    found = {r["node_id"]: r for r in degree.degree_table(frame(spark, MICRO)).collect()}
    assert found[5]["iand_total"] == 3.076923076923077
    assert found[3]["and_total"] == 3.3333333333333335


def test_distinct_and_bounds(spark):
    edges = frame(spark, MICRO + MICRO)
    once = graph.distinct_edges(edges)
    assert once.count() == len(MICRO) == graph.distinct_edges(once).count()
    bounds = spark.createDataFrame([(3, 1)], "known long, unknown long")
    assert {r["from"] for r in graph.distinct_edges(edges, bounds).collect()} == {-1, 0, 2, 3}
    assert graph.self_loops(once).count() == 1
    assert graph.reverse(graph.reverse(once)).exceptAll(once).count() == 0
    assert {r[0] for r in graph.sources(once).collect()} == {a for a, _ in MICRO}


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    got = ids.dense_index(df, ["k"], "n", 5)
    assert got.where("n <> k + 5").count() == 0
    assert ids.dense_index(df.where("k < 0"), ["k"]).count() == 0


def test_batches_belong_to_their_graph(spark, tmp_path):
    """One folder for two graphs, two variants and two numbers of batches: none reads what another has left."""
    graphs = [[(1, 2), (2, 3), (3, 4), (1, 3)], [(11, 12), (12, 13), (13, 14), (14, 15), (12, 14)]]
    for _ in range(2):
        for edges in graphs:
            frame = spark.createDataFrame(edges, "`from` long, `to` long")
            for variant in bt.VARIANTS:
                expected = {tuple(r) for r in bt.betweenness(frame, variant).collect()}
                for batches in (1, 3):
                    assert {tuple(r) for r in bt.betweenness_in_batches(frame, f"file://{tmp_path}/state", batches, variant).collect()} == expected
    assert len(list(tmp_path.glob("state/graph=*/variant=*/batches=*"))) == 8


def test_levels_in_batches_of_sources(spark):
    edges = spark.createDataFrame([(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 2)], "`from` long, `to` long").distinct()
    whole = {r["node_id"]: r["betweenness"] for r in bt.betweenness(edges, method="tasks").collect()}
    parts = bt._by_batches(edges, graph.sources(edges), "reference", 800)
    assert {r["node_id"]: pytest.approx(r["part"]) for r in parts.where("part <> 0").collect()} == whole


def test_rows_within_bounds(spark):
    rows = spark.createDataFrame([(i,) for i in (-3, -2, 0, 5, 6)], "node_id long")
    assert sorted(r[0] for r in graph.within(rows, 5, 2).collect()) == [-2, 0, 5]
