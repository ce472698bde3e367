from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tracelattice.llm import lines, substring

from .data import documents, prose


def plain_line_dedup(texts: dict[int, str], run: int) -> dict[int, str]:
    first: dict[tuple, tuple] = {}
    windows = []
    for i, t in sorted(texts.items()):
        parts = [(k, x.strip(lines.SPACE)) for k, x in enumerate(t.split("\n"))]
        parts = [p for p in parts if p[1]]
        for k in range(len(parts) - run + 1):
            key = tuple(p[1] for p in parts[k : k + run])
            first.setdefault(key, (i, k))
            windows.append((key, (i, k), i, [p[0] for p in parts[k : k + run]]))
    gone = {i: set() for i in texts}
    for key, at, i, places in windows:
        if at > first[key]:
            gone[i] |= set(places)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup(spark, run):
    rng = random.Random(run)
    pool = [f"line {i}" for i in range(12)] + ["", "  "]
    texts = {i: "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 14))) for i in range(60)}
    found = {r["doc_id"]: r["text"] for r in lines.drop_lines(documents(spark, texts), run).collect()}
    assert found == plain_line_dedup(texts, run)


def test_line_dedup_has_no_python(spark):
    plan = lines.drop_lines(documents(spark, ["a\nb\nc\nd"] * 3))._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_line_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(9)
    texts = ["\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 20))) for _ in range(80)]
    documents(spark, texts).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = sorted(tuple(r) for r in lines.op7(spark, f"file://{tmp_path}").collect())
    assert ours == sorted(db.sql(lines.ORACLE).fetchall())


def best_chain(x, y, size, gap):
    """The best score over all pairs of links, in quadratic time."""
    best = []
    for i, j in enumerate(order := sorted(range(len(x)), key=lambda i: (y[i], x[i]))):
        value = float(size)
        for k, before in zip(order[:i], best):
            dx, dy = x[j] - x[k], y[j] - y[k]
            if dx >= size and dy >= size:
                value = max(value, before + size - gap * (dx + dy - 2 * size))
            elif dx == dy > 0:
                value = max(value, before + dx)
        best.append(value)
    return max(best)


def score_of(x, y, size, gap):
    steps = zip(np.diff(x).tolist(), np.diff(y).tolist())
    return size + sum(min(size, dx) - gap * (max(0, dx - size) + max(0, dy - size)) for dx, dy in steps)


@pytest.mark.parametrize(("places", "links", "gap"), [(60, 25, 0.05), (60, 60, 0.2), (400, 60, 0.05), (12, 40, 0.5)])
def test_chains_are_collinear_and_best(places, links, gap):
    rng = random.Random(places + links)
    for _ in range(60):
        found = sorted({(rng.randint(0, places), rng.randint(0, places)) for _ in range(links)} | {(k, k + 3) for k in range(rng.randint(0, 10))})
        x, y = np.array([a for a, _ in found]), np.array([b for _, b in found])
        chains = substring.chain(x, y, 5, gap)
        assert sorted(i for c in chains for i in c) == list(range(len(found)))
        for c in chains:
            assert (np.diff(x[c]) > 0).all()
            assert (np.diff(y[c]) > 0).all()
        best = best_chain(x.tolist(), y.tolist(), 5, gap)
        assert score_of(x[chains[0]], y[chains[0]], 5, gap) == pytest.approx(best)


def test_seeds_of_equal_runs():
    """A copy has every seed of the passage, whatever stands around it, and 50 words have some."""
    rng = random.Random(3)
    for _ in range(50):
        shared = prose(rng, 50)
        own = set(substring.seeds(substring.word_hashes(shared))[0].tolist())
        assert own
        assert own <= set(substring.seeds(substring.word_hashes(f"{prose(rng, rng.randint(0, 40))} {shared} {prose(rng, rng.randint(0, 40))}"))[0].tolist())
    assert len(substring.seeds(substring.word_hashes("a " * 50))[0]) == 51 - substring.SEED


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for w in a:
        old = row[:]
        for j, v in enumerate(b):
            row[j + 1] = max(old[j + 1], row[j], old[j] + (v == w))
    return row[-1]


def test_gaps_equal_the_longest_common_subsequence():
    """Within the band the value is exact; beyond it, it is no larger."""
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randint(0, 30) for _ in range(rng.randint(0, 150))]
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            if b:
                k = rng.randrange(len(b))
                b[k : k + rng.randint(0, 1)] = [rng.randint(0, 30)] * rng.randint(0, 1)
        best = plain_lcs(a, b)
        found = substring._gap(np.array(a, np.uint64), np.array(b, np.uint64))
        assert found <= best
        assert found == best or max(len(a), len(b)) - best > substring.BREAK


def test_alignment():
    words = np.arange(100, dtype=np.uint64)
    other = np.r_[np.full(5, 900, np.uint64), words, np.full(7, 901, np.uint64)]
    assert substring.align(words, other, np.array([40]), np.array([45])) == [(0, 100, 5, 105, 100, 100)]
    changed = other.copy()
    changed[60] = 999
    assert substring.align(words, changed, np.array([10, 70]), np.array([15, 75])) == [(0, 100, 5, 105, 99, 100)]
    # thirty words between the halves belong to one side only: two passages
    apart = np.r_[words[:50], np.arange(500, 530, dtype=np.uint64), words[50:]]
    assert substring.align(words, apart, np.array([10, 70]), np.array([10, 100])) == [(0, 50, 0, 50, 50, 50), (50, 100, 80, 130, 50, 50)]


@pytest.mark.parametrize("edit", [0, 1, 2])
def test_planted_passages(spark, edit):
    rng = random.Random(edit)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(80)]
    planted = {}
    for k in range(10):
        passage = prose(rng, rng.randint(60, 120)).split()
        for d in range(k, 80, 20):
            p = list(passage)
            if d != k:
                for _ in range(edit):
                    p[rng.randrange(20, len(p))] = f"edit{rng.random()}"
            words = texts[d].split()
            at = rng.randrange(len(words))
            texts[d] = " ".join(words[:at] + p + words[at:])
            planted[d] = (k, at, at + len(p))
    found = substring.repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in found} == {d for d, (k, _, _) in planted.items() if d != k}
    for r in found:
        k, lo, hi = planted[r["doc_id"]]
        assert lo - 2 <= r["start_word"] <= r["end_word"] <= hi + 2
    covered = {d: set() for d in planted}
    for r in found:
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    for d, (k, lo, hi) in planted.items():
        if d != k:
            assert len(covered[d] & set(range(lo, hi))) >= 0.9 * (hi - lo)
    kept = {r["doc_id"]: r for r in substring.drop_passages(documents(spark, texts)).collect()}
    assert len(kept) == len(texts)
    for i, t in enumerate(texts):
        if i in planted and planted[i][0] != i:
            assert len(kept[i]["text"].split()) == len(t.split()) - len(covered[i])
            assert kept[i]["n_chars"] == len(kept[i]["text"])
        else:
            assert kept[i]["text"] == t


def test_texts_full_of_repeats(spark):
    """Two words said over and over make equal seeds; copies of such a passage are found all the same."""
    rng = random.Random(12)
    passage = "is onhe. " * 200
    texts = [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" if i % 3 else prose(rng, 80) for i in range(12)]
    kept = {r["doc_id"]: len(r["text"].split()) for r in substring.drop_passages(documents(spark, texts)).collect()}
    assert all(kept[i] == len(texts[i].split()) for i in (0, 1, 3, 6, 9))
    assert all(kept[i] <= 80 + 40 for i in range(12) if i % 3 and i != 1)


def test_versions(spark):
    """Each version edits the one before, so a late one is far from the first and near to the last but one."""
    rng = random.Random(20)
    passage, versions, texts, places = prose(rng, 80).split(), [], [], {}
    for i in range(40):
        words, at = prose(rng, rng.randint(60, 120)).split(), rng.randint(0, 60)
        if i % 2:
            for _ in range(3):
                passage[rng.randrange(len(passage))] = f"edit{rng.random()}"
            words[at:at] = passage
            places[i] = (at, at + len(passage))
            versions.append((i, list(passage)))
        texts.append(" ".join(words))
    brute = {i for k, (i, p) in enumerate(versions) if any(sum(a == b for a, b in zip(p, q)) >= 0.8 * len(p) for _, q in versions[:k])}
    covered = {i: set() for i in range(40)}
    for r in substring.repeated_passages(documents(spark, texts)).collect():
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert {i for i, c in covered.items() if c} == brute == set(places) - {1}
    assert all(len(covered[i] & set(range(*places[i]))) >= 0.8 * 80 for i in brute)


def test_fuzzy_passages(spark):
    """Passages at 0.8 to 0.95 identity, edited at random or at even steps; brute force over all diagonals finds the same texts."""
    rng = random.Random(31)
    texts = []
    for i in range(24):
        passage = prose(rng, 65).split()
        later = list(passage)
        places = range(2, 65, 5) if i % 4 == 0 else rng.sample(range(65), (3, 6, 10)[i % 3])
        for k in places:
            later[k] = f"edit{rng.random()}"
        for p in (passage, later):
            words = prose(rng, 60).split()
            words[30:30] = p
            texts.append(" ".join(words))
    split = [t.split() for t in texts]
    brute = set()
    for i, a in enumerate(split):
        for b in split[:i]:
            for shift in range(50 - len(a), len(b) - 49):
                same = np.array([x == y for x, y in zip(a[max(0, -shift) :], b[max(0, shift) :])])
                if len(same) >= 50 and np.convolve(same, np.ones(50, int), "valid").max() >= 40:
                    brute.add(i)
                    break
    assert brute == set(range(1, 48, 2))
    found = {r["doc_id"] for r in substring.repeated_passages(documents(spark, texts)).collect()}
    assert found == brute


def edited(rng, passage, rate, kinds):
    out = []
    for w in passage:
        kind = rng.choice(kinds) if rng.random() < rate else ""
        out += {"": [w], "substitute": [f"edit{rng.random()}"], "insert": [w, f"edit{rng.random()}"], "delete": []}[kind]
    return out


def test_recall_of_edited_passages(spark):
    """Passages of 100 words, any of them edited: share found, and share covered to nine tenths."""
    rng = random.Random(44)
    least = {("substitute",): {0.05: (1.0, 1.0), 0.1: (1.0, 1.0), 0.15: (0.9, 0.9), 0.18: (0.7, 0.7)}, ("substitute", "insert", "delete"): {0.05: (1.0, 0.9), 0.1: (0.95, 0.85), 0.15: (0.8, 0.65), 0.18: (0.7, 0.6)}}
    texts, planted = [], {}
    for kinds, rates in least.items():
        for rate in rates:
            for _ in range(40):
                passage = prose(rng, 100).split()
                later = edited(rng, passage, rate, kinds)
                around = prose(rng, 150).split()
                texts += [" ".join([*prose(rng, 60).split(), *passage, *prose(rng, 60).split()]), " ".join([*around[:70], *later, *around[70:]])]
                planted[len(texts) - 1] = (kinds, rate, 70, 70 + len(later))
    covered = {i: set() for i in planted}
    for r in substring.repeated_passages(documents(spark, texts)).collect():
        assert r["doc_id"] in planted
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    for kinds, rates in least.items():
        for rate, (found, whole) in rates.items():
            shares = [len(covered[i] & set(range(lo, hi))) / (hi - lo) for i, (k, q, lo, hi) in planted.items() if (k, q) == (kinds, rate)]
            assert np.mean([s > 0 for s in shares]) >= found, (kinds, rate, shares)
            assert np.mean([s >= 0.9 for s in shares]) >= whole, (kinds, rate, shares)


def test_links_of_seeds_across_batches():
    """The first and the nearest earlier holder of each seed, wherever the batches are cut."""
    rows = [(*r, 5) for r in [(1, d, d * 10, -1) for d in (2, 3, 5, 7)] + [(2, 4, 1, -1)] + [(3, 4, 2, 0), (3, 9, 3, -1)] + [(4, 6, 8, 1)]]
    expected = sorted([(3, 2, 30, 20), (5, 2, 50, 20), (5, 3, 50, 30), (7, 2, 70, 20), (7, 5, 70, 50), (4, 4, 2, 0), (9, 4, 3, 2), (6, 6, 8, 1)])
    for size in range(1, len(rows) + 1):
        table = pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("h", "doc", "pos", "before", "sides"), zip(*rows))})
        found = [tuple(r.values())[:4] for b in substring._linked(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(found) == expected


def test_cut():
    assert substring.cut(" a b  c\nd ", [(1, 3)]) == " a d "
    assert substring.cut("a b c", [(0, 2), (1, 3)]) == ""
    assert substring.cut("a b c", []) == "a b c"
