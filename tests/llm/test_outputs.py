from __future__ import annotations

import io
import itertools
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tracelattice.llm import bpe, neighbours, packing, shards, warc
from tracelattice.llm.base import grouped, shared_folder

from .data import corpus, documents, prose


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 40))
def test_feistel_is_a_permutation(n, key):
    assert sorted(shards.feistel(np.arange(n), n, key).tolist()) == list(range(n))


def test_feistel_mixes_and_follows_its_key():
    a, b = shards.feistel(np.arange(5000), 5000, 1), shards.feistel(np.arange(5000), 5000, 2)
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.1
    assert (shards.feistel(np.array([17, 4]), 5000, 1) == a[[17, 4]]).all()


def test_shards_hold_every_token(spark, tmp_path):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(50)] + ["", None, "x<|endoftext|>y", " " * 20000]
    documents(spark, texts).coalesce(1).write.parquet(f"file://{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/d.parquet")
    folder = shared_folder(spark, "t")
    rows = shards.materialise(docs, folder, 64, 16)
    found = sorted(rows.collect(), key=lambda r: r["sequence"])
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
    stored = {}
    for shard in {r["shard"] for r in found}:
        for k, s in enumerate(shards.read_shard(f"{folder}/{shards.shard_name(shard)}", 64)):
            stored[shard * 16 + k] = s
        tail = list(shards.read_shard(f"{folder}/{shards.shard_name(shard)}", 64, skip=3))
        assert all((stored[shard * 16 + 3 + k] == s).all() for k, s in enumerate(tail))
    stream = np.concatenate([stored[r["slot"]][: r["n_tokens"]] for r in found])
    coder = bpe.encoder(bpe.vocabulary_path())
    expected = np.concatenate([np.r_[coder.encode_ordinary(t), shards.END] for t in texts])
    assert (stream == expected).all()
    assert shards.feistel(np.arange(len(found)), len(found)).tolist() == [r["slot"] for r in found]
    spans = [(s["doc_id"], s["tokens"]) for r in found for s in r["documents"]]
    assert sum(t for _, t in spans) == len(expected)
    checked = shards.read_back(rows, folder, 64).collect()
    assert all(r["crc32"] == r["read_crc32"] for r in checked)


def test_archives():
    rng = random.Random(2)
    for count in (1, 3, 400):
        records = [warc.record("response", i, f"http://h/{i}", b"\1" * 20, 9, prose(rng, 50).encode(), None) for i in range(count)]
        out = io.BytesIO()
        warc.write_archive(records, out)
        data = out.getvalue()
        assert list(warc.read_archive(data)) == records
        # the leading frame is skippable: a reader that knows the dictionary sees plain frames
        size = int.from_bytes(data[4:8], "little")
        first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompress(data[8 + size : warc.frame_end(data, 8 + size)])
        assert first == records[0]
    assert len(data) < sum(map(len, records)) / 2
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0" * 20))
    fields, http, payload = warc.parse(warc.record("response", 5, "a\r\nb: c", b"\1" * 20, 3, b"a\r\n\r\nb", None))
    assert fields["WARC-Target-URI"] == "a%0D%0Ab: c"
    assert payload == b"a\r\n\r\nb"


def test_smallest_payload(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    found = {r["page_id"]: r["kind"] for r in warc.plan(pages, 4).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 24)) * 0.6).astype(np.float32)
    x[100:160] = x[100]  # ties
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in neighbours.search(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x = x.astype(float)
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        assert len(got[q]) == 20
        hits += len({v for v, _ in got[q]} & set(best.tolist()))
        assert all(abs(s[v] - score) < 1e-9 for v, score in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(got)) >= 0.9


def plain_fill(lengths, sizes, policy):
    """The same rule by scanning all open bins; of equal room the bin touched last."""
    rest, bins = sum(lengths), []
    own = lambda n: next(c for c in sizes if c >= n)
    for step, n in enumerate(sorted(lengths, reverse=True)):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[2]))
        else:
            b = [min(policy[own(n)], own(min(rest, sizes[-1]))), 0, step]
            bins.append(b)
        b[0] -= n
        b[1] += n
        b[2] = step
        rest -= n
    return sorted(b[1] for b in bins)


def price(filled, sizes, cost):
    return sum(cost(next(c for c in sizes if c >= used)) for used in filled)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_pack(lengths):
    sizes, cost = (10, 20, 40), lambda c: c * (1 + c / 60) + 1
    where, offset, final = packing.pack(lengths, sizes, cost)
    filled: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (where[i], offset[i], lengths[i])):
        assert offset[i] == filled.get(where[i], 0)
        filled[where[i]] = offset[i] + lengths[i]
    for b, used in filled.items():
        assert final[b] == min(c for c in sizes if c >= used)
    policies = [dict(zip(sizes, p)) for p in itertools.product(sizes, sizes, sizes) if all(c >= s for c, s in zip(p, sizes))]
    every = {price(plain_fill(lengths, sizes, p), sizes, cost): sorted(plain_fill(lengths, sizes, p)) for p in policies}
    ours = sum(map(cost, final))
    assert any(ours == pytest.approx(v) for v in every)
    for fixed in ({s: sizes[-1] for s in sizes}, {s: s for s in sizes}):
        assert ours <= price(plain_fill(lengths, sizes, fixed), sizes, cost) + 1e-9
    with pytest.raises(ValueError):
        packing.pack([41], sizes)


def test_sizes_are_chosen_together():
    """Cheaper than the largest size always, and where lengths are awkward than each item's own size always."""
    rng = random.Random(12)
    sizes = packing.CAPACITIES
    for lengths, own in (([min(4096, int(rng.lognormvariate(6.3, 1.0))) for _ in range(4000)], 1.0), ([rng.choice([260, 300, 700, 90]) for _ in range(4000)], 0.95)):
        opened = packing.pack(lengths)[2]
        ours = sum(map(packing.bin_cost, opened))
        always = [price(plain_fill(lengths, sizes, p), sizes, packing.bin_cost) for p in ({s: sizes[-1] for s in sizes}, {s: s for s in sizes})]
        assert ours < 0.97 * always[0]
        assert ours <= own * always[1]
        assert any(c < sizes[-1] for c in opened)


def test_packed_sequences_hold_the_tokens(spark):
    from tracelattice.llm import bpe

    rng = random.Random(13)
    texts = {i: t for i, t in enumerate([None, "", *(prose(rng, rng.choice([3, 100, 700, 4000])) for _ in range(30))])}
    docs = documents(spark, texts)
    ids = {r["doc_id"]: [*r["ids"], shards.END] for r in bpe.encode(docs).collect()}
    found: dict[int, dict] = {i: {} for i in texts}
    for b in packing.pack_texts(docs, group=16).collect():
        sequence = np.frombuffer(b["ids"], "<u2").tolist()
        assert len(sequence) == b["used"] <= b["capacity"]
        at = 0
        for d in b["documents"]:
            assert d["offset"] == at
            at += d["length"]
            found[d["doc_id"]][d["start"]] = sequence[d["offset"] : at]
        assert at == b["used"]
    assert {i: sum((p for _, p in sorted(v.items())), []) for i, v in found.items()} == ids


def test_packing_table(spark):
    rng = random.Random(6)
    lengths = [(i, rng.choice([0, 3, 40, 500, 1500, 4096, 9000])) for i in range(400)] + [(None, 5), (3, 7), (3, 7), (5, None), (6, -2)]
    found = packing.pack_lengths(spark.createDataFrame(lengths, "doc_id long, length long"), group=64).collect()
    assert sum(r["length"] for r in found) == sum(max(0, n or 0) for _, n in lengths)
    bins: dict[tuple, list] = {}
    for r in found:
        bins.setdefault((r["pack"], r["bin"]), []).append(r)
    for rows in bins.values():
        assert sum(r["length"] for r in rows) == rows[0]["used"] <= rows[0]["capacity"]
        at = 0
        for r in sorted(rows, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == next(i for i, n in lengths if n == 9000))
    assert pieces == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 808)]


def test_grouped():
    import pyarrow as pa

    keys = [0, 0, 1, 1, 1, 2, 5, 5, 6]
    for cut in range(1, 9):
        table = pa.table({"k": keys, "v": list(range(9))})
        groups = [g.column("v").to_pylist() for g in grouped(iter(table.to_batches(max_chunksize=cut)), 1)]
        assert groups == [[0, 1], [2, 3, 4], [5], [6, 7], [8]]


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    texts = corpus(3, 80)
    insults = ["scoundrel", "wretchedly", "vermin", "dimwitted"]
    for i in range(0, 80, 5):
        texts[i] += " " + " ".join(rng.sample(insults, 3))
    documents(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 80 and i % 5 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    docs = documents(spark, texts)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
    kept = {r["doc_id"]: len(r["ids"]) + 1 for r in bpe.encode(docs).collect()}  # and the end mark
    assert sum(r["length"] for r in found) == sum(kept.values())
    assert {r["doc_id"] for r in found} == set(kept)
    assert not any(any(w in texts[i] for w in insults) for i in kept if i < 80)
