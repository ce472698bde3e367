"""No source of a passage is missed because other texts hold its seeds first and last."""

from __future__ import annotations

import random

from tracelattice.llm import substring

from .data import documents


def test_source_among_other_holders_of_its_seeds(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    some = lambda n: [word() for _ in range(n)]
    shared = some(60)
    holders = lambda: [" ".join(some(20) + shared[k : k + substring.SEED] + some(20)) for k in range(len(shared) - substring.SEED + 1)]
    before, between, copies = holders(), holders(), [" ".join(some(30) + shared + some(30)) for _ in range(3)]
    texts = [*before, copies[0], *between, copies[1], *holders(), copies[2]]
    found = substring.repeated_passages(documents(spark, texts)).collect()
    place = texts.index
    assert {r["doc_id"] for r in found} == {place(copies[1]), place(copies[2])}
    for r in found:
        assert (r["start_word"], r["end_word"], r["identity"]) == (30, 90, 1)


def test_classes_of_occurrences_are_not_paired_again(spark):
    """Copies that a first source has gathered make no links among each other."""
    rng = random.Random(12)
    shared = " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))
    texts = [f"{k} {shared} {k}" for k in range(40)]
    found = substring.repeated_passages(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 40))
    assert len(found) <= 2 * 39
