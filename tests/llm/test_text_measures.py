from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelattice.llm import bpe, quality, toxicity

from .data import documents, prose


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#<\n\t\x85", max_size=60))
def test_quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found, _ = quality.measure(text)
    assert found == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_repetition_coverage():
    rng = random.Random(1)
    for _ in range(20):
        base = prose(rng, 12, 30).split()
        text = " ".join(base + prose(rng, 20, 40).split() + base)
        words = text.split()
        _, shares = quality.measure(text)
        got = dict(zip(quality._SHARES, shares))
        for n in quality.MAX_DUPLICATE:
            seen, covered = set(), set()
            for i in range(len(words) - n + 1):
                g = tuple(words[i : i + n])
                if g in seen:
                    covered |= set(range(i, i + n))
                seen.add(g)
            assert got[f"dup_{n}gram"] == pytest.approx(sum(len(words[i]) for i in covered) / sum(map(len, words)))


def test_verdicts(spark):
    rng = random.Random(2)
    clean, block = prose(rng, 300), prose(rng, 30)
    texts = {1: clean, 2: "few words", 3: " ".join([prose(rng, 60)] + [block] * 6), 4: "# " * 40 + clean[:400], 5: None, 6: "\n".join([block] * 20)}
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(documents(spark, texts)).collect()}
    assert found[1] == (False, True)
    assert not any(found[i][1] for i in (2, 3, 4, 5, 6))


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="aehint '\n\x85\xa0 <|endoftx>", max_size=80))
def test_bpe_equals_the_library(coder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == ids
    assert coder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_special_and_long(coder, library):
    for text in ("a<|endoftext|>b<|endoftext|>", " " * 30000 + "x", "x" * 30000, "ab" * 20000, "<|endoftext|"):
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.encode_ordinary("a<|endoftext|>").tolist() != coder.encode("a<|endoftext|>").tolist()
    assert coder.decode(np.array([220, 255])) == library.decode([220, 255], skip_special_tokens=False)


def test_bpe_table(spark, library):
    texts = {1: "Some text, twice. Some text", 2: None, 3: "", 4: "naïve 日本 🙂"}
    found = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, texts)).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(documents(spark, texts))).collect()}
    assert back == {i: t or "" for i, t in texts.items()}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=3, max_size=11), min_size=1, max_size=6, unique=True), st.lists(st.text(alphabet="abcd", max_size=13), max_size=8), st.booleans())
def test_automaton_equals_edit_distance(terms, words, prefix):
    matcher = toxicity.Matcher([toxicity.Term(t, prefix) for t in terms])
    for w in words:
        best = None
        for k, t in enumerate(terms):
            e = min(edits(w[:i], t) for i in range(len(w) + 1)) if prefix else edits(w, t)
            if e <= toxicity.allowed_edits(len(t)):
                best = min(best or (99, 0), (e, k))
        found = matcher.match(w)
        assert (found is None) == (best is None)
        assert found is None or found[0] == best[0]


def test_quotation_and_abuse():
    matcher = toxicity.Matcher([toxicity.Term("moron", False)])
    model = toxicity.Model(matcher.terms)
    abuse, quoted = toxicity.features("you are a moron", matcher), toxicity.features('they used the word "moron" once', matcher)
    assert abuse[0] == 1 and abuse[2] == 0
    assert quoted[0] < 0.1 and quoted[2] > 0.9
    assert toxicity.features("you m0ron, you mor*n", matcher)[1] == 2
    assert toxicity.features("a moran", matcher)[1] == 1
    assert toxicity.features("you morron", matcher)[1] == 1
    assert toxicity.features(None, matcher) == [0, 0, 0, 0, 0]
    assert 0 <= model.predict(np.array([abuse]))[0] <= 1


def test_masked_short_terms():
    """A digit or sign in place of a letter counts in short terms too; another letter does not."""
    matcher = toxicity.Matcher([toxicity.Term("scum", False), toxicity.Term("pig", True)])
    assert [matcher.match(w) for w in ("scum", "sc*m", "5cum", "slum", "s**m")] == [(0, 0), (1, 0), (1, 0), None, None]
    assert [matcher.match(w) for w in ("piglet", "p1glet", "puglet")] == [(0, 1), (1, 1), None]
    assert toxicity.features("**scum** sc*m! 2024 a_b", matcher)[:4] == [1, 1, 0, 0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='x"“”«»\n', max_size=40))
def test_quotation_marks_of_a_line(text):
    found = toxicity.Quotations(text)
    for k in range(len(text) + 1):
        line = text[text.rfind("\n", 0, k) + 1 : k]
        assert found.inside(k) == (line.count('"') % 2 == 1 or any(line.rfind(o) > line.rfind(c) for o, c in zip("“«", "”»")))


def test_training_rows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(k, f"text {j}") for k in range(4) for j in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    found = toxicity.training_rows(docs, labels, 2).collect()
    assert [r["text"] for r in found] == ["text 0"] * 2


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    texts, rows = {}, []
    for i in range(1500):
        words, bad = prose(rng, 40, 2000).split(), i % 6 == 0
        if bad:
            for w in rng.sample(["scoundrel", "wretchedly", "vermin", "dimwitted"], 2):
                words.insert(rng.randrange(len(words)), w if rng.random() < 0.8 else w.replace("r", "rr"))
        texts[i] = " ".join(words)
        rows.append((i, int(bad)))
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    docs = documents(spark, texts)
    model = toxicity.train(docs, labels)
    matcher = toxicity.Matcher(model.terms)
    assert all(matcher.match(w) for w in ("scoundrel", "wretchedly", "vermin", "dimwitted", "dimwited"))
    found = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect()}
    from zlib import crc32

    held = [i for i in texts if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i] == bool(dict(rows)[i]) for i in held]) > 0.98
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, bad in found.items() if not bad}
    assert toxicity.training_rows(docs, labels, 100).count() == 100
