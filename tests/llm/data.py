"""Small tables with every awkward row: nulls, empties, repeats, ties, long texts, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, id int, kept int, doc int, hash int, gone int, lines int, spans int, fp int, score double, length int, `a.b` int"
PASSAGE = " ".join(f"passage{i}" for i in range(70))
LINES = "\n".join(f"line number {i} of some text" for i in range(8))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40000))


def row(i, text):
    return (i, text, None, None, None if text is None else len(text), 1, 2, 3, 4, 5, 6, 7, 8, 9, 0.5, 1, 2)


ROWS = [
    row(1, None), row(2, ""), row(3, "   \n\n \t"), row(None, "null id " + PASSAGE), row(4, LONG), row(5, LONG), row(6, PASSAGE), row(7, "start " + PASSAGE + " end"), row(7, "start " + PASSAGE + " end"),
    row(8, LINES), row(9, "a\n" + LINES + "\nb"), row(10, "one"), row(11, "one"), row(None, None), row(12, "퟿ héé <|endoftext|> " + "the " * 300), row(13, "a " * 10 + "b" * 50000),
]


def awkward(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts):
    rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def prose(rng: random.Random, words: int, vocabulary: int = 3000) -> str:
    return " ".join(f"v{rng.randint(0, vocabulary)}" for _ in range(words))


def corpus(seed: int = 1, n: int = 60) -> list[str]:
    """Documents with exact and near copies and shared passages."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(n)]
    for i in range(0, n, 4):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i])
    return texts
