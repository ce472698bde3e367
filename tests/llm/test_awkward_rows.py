"""Every operator and stage over the awkward rows and over an empty table."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tracelattice.llm import bpe, lines, neighbours, packing, quality, shards, simhash, substring, toxicity, warc
from tracelattice.llm.base import shared_folder

from .data import ROWS, awkward, nothing


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    rows = [(i, 1, i % 2) for i in range(1, 14)] + [(None, 1, 1), (6, None, None), (6, 1, 1), (6, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/full/labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/none/labels.parquet")
    return folder


@pytest.mark.parametrize("make", [awkward, nothing])
def test_operators(spark, make, labels):
    docs = make(spark)
    n = docs.count()
    assert len(simhash.near_duplicates(docs).collect()) == n
    assert len(quality.quality(docs).collect()) == n
    assert len(bpe.round_trip(docs).collect()) == n
    assert len(bpe.decode(bpe.encode(docs)).collect()) == n
    assert len(lines.dedup_lines(docs).collect()) == n
    assert len(packing.placements(packing.pack_texts(docs)).collect()) >= n
    assert len(shards.materialise(docs, shared_folder(spark, "t"), 64, 8).collect()) >= (n > 0)
    for kind in ("full", "none"):
        model = toxicity.train(docs, spark.read.parquet(f"file://{labels}/{kind}/labels.parquet"))
        scores = [r["score"] for r in toxicity.score(docs, model).collect()]
        assert len(scores) == n
        assert all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("make", [awkward, nothing])
@pytest.mark.parametrize("kind", ["full", "none"])
def test_stages_keep_the_columns(spark, make, kind, labels):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, f"file://{labels}/{kind}")
        assert found.dtypes == docs.dtypes, name
        assert len(found.collect()) <= docs.count()
    corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_near_copies_of_awkward_rows(spark):
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(awkward(spark)).collect()}
    assert found[(2, 0)] == found[(3, 0)] == found[(None, 0)] == 1  # without words, without an id
    assert {c for (i, _), c in found.items() if i in (10, 11)} == {10}
    texts = spark.createDataFrame([(1, "a b c d e"), (7, "a b c d e"), (7, "quite another text here"), (8, "quite another text here")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(texts).collect()) == [(1, "a b c d e"), (7, "quite another text here")]
    assert len(simhash.drop_near_duplicates(awkward(spark)).where("doc_id IS NULL").collect()) == 2


def test_passages_of_awkward_rows(spark):
    found = substring.repeated_passages(awkward(spark)).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == {(4, 4), (5, 4), (5, 5), (7, 6)}
    kept = {(r["doc_id"], r["text"]) for r in substring.drop_passages(awkward(spark)).collect()}
    assert (7, "start end") in kept
    assert (6, ROWS[6][1]) in kept
    assert (None, ROWS[3][1]) in kept


def test_pages(spark):
    rows = [(1, "u", "abc"), (2, "u\r\nX: y", None), (3, None, ""), (None, "n", "abc"), (5, "x", "abc"), (5, "x", "abc"), (6, "é", "héllo " * 300000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.read(warc.write(pages, shared_folder(spark, "w"))).collect()
    assert len(found) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found)
    assert kinds == [(0, "revisit", 3), (0, "revisit", 5), (1, "revisit", 5), (2, "revisit", 3), (3, "response", 0), (5, "response", 0), (5, "response", 0), (6, "response", 0)]
    assert warc.read(warc.write(pages.limit(0), shared_folder(spark, "w"))).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)] + [(200, None), (220, []), (240, [0.0] * 3), (260, [nan, 1.0, 1.0]), (280, [None, 1.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0] * 3), (40, [9.0] * 3), (320, [inf, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(vectors).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40, 60, 80}
    assert len(found) == 100
    assert neighbours.search(vectors.where("vec_id = 20")).count() == 0
    assert neighbours.search(vectors.where("vec_id >= 200")).count() == 0
    few = neighbours.search(vectors.where("vec_id < 5")).collect()
    assert [r["vec_id"] for r in few] == [r["vec_id"] for r in sorted(few, key=lambda r: (-r["score"], r["vec_id"]))]
    assert len(few) == 4
