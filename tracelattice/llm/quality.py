"""Quality rules on repetition: characters inside duplicated word n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table

SYMBOLS = "#*$%&|<>"
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest share of word characters inside n-grams that occurred earlier in the text, by n.
MAX_DUPLICATE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of word characters inside the most frequent n-gram that occurs twice or more, by n.
MAX_TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of lines, and of word characters, in lines equal to an earlier line.
MAX_DUP_LINES, MAX_DUP_LINE_CHARS = 0.35, 0.25
#: Largest number of symbols for each word.
MAX_SYMBOLS = 0.10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHARES = [*(f"dup_{n}gram" for n in MAX_DUPLICATE), *(f"top_{n}gram" for n in MAX_TOP), "dup_lines", "dup_line_chars", "symbols"]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and where each group of equals begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])


def _repeated(keys: np.ndarray, first: bool = True) -> np.ndarray:
    """Which keys occur twice or more; without ``first``, only those seen before."""
    order, begins = _groups(keys)
    sizes = np.diff(np.r_[begins, len(keys)])
    marks = np.repeat(sizes > 1, sizes)
    if not first:
        marks[begins] = False
    out = np.empty(len(keys), bool)
    out[order] = marks
    return out


def _covered(windows: np.ndarray, n: int) -> np.ndarray:
    """Words inside the marked windows of n words."""
    edge = np.zeros(len(windows) + n, np.int32)
    edge[: len(windows)] += windows
    edge[n : n + len(windows)] -= windows
    return np.cumsum(edge)[:-1] > 0


def _triples(ids: np.ndarray) -> np.ndarray:
    """An exact key of every three words in a row."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if len(ids) < 1 << 21:
        return (a << 42) | (b << 21) | c
    pairs = np.unique((a << 32) | b, return_inverse=True)[1]
    return (pairs.astype(np.int64) << 32) | c


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts of ``_MEASURES`` and the shares of ``_SHARES``; zeros without a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(_SHARES)
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = points[edges[1::2]] - points[edges[::2]]
    total = int(chars.sum())

    lines, seen, dup_lines, dup_line_chars = 0, set(), 0, 0
    for line in raw.split(b"\n"):
        if parts := line.split():
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(p.decode("utf-8", "surrogatepass")) for p in parts)
            else:
                seen.add(line)

    number = dict(zip(words, range(n)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    repeat = int(_covered(_repeated(_triples(ids)), 3).sum()) if n >= 3 else 0
    shares = dict.fromkeys(_SHARES, 0.0)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    rolling = mixed
    for k in range(2, max(MAX_DUPLICATE) + 1):
        if n < k:
            break
        rolling = rolling[:-1] * _BASE + mixed[k - 1 :]
        if k in MAX_DUPLICATE:
            again = _repeated(rolling, first=False)
            if not again.any():
                break  # a longer n-gram that occurs twice would hold a shorter one
            shares[f"dup_{k}gram"] = float(chars[_covered(again, k)].sum() / total)
        elif k in MAX_TOP:
            order, begins = _groups(rolling)
            sizes = np.diff(np.r_[begins, len(rolling)])
            most = sizes.max()
            if most > 1:
                tied = np.flatnonzero(sizes == most)
                top = tied[np.argmin(np.minimum.reduceat(order, begins)[tied])]
                windows = np.zeros(len(rolling), bool)
                windows[order[begins[top] : begins[top] + most]] = True
                shares[f"top_{k}gram"] = float(chars[_covered(windows, k)].sum() / total)
    shares |= {"dup_lines": dup_lines / lines, "dup_line_chars": dup_line_chars / total, "symbols": symbols / n}
    return [n, total, symbols, dup_lines, repeat], [shares[k] for k in _SHARES]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column(1)]
        counts = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(_MEASURES))]
        shares = [pa.array([f[1][i] for f in found], pa.float64()) for i in range(len(_SHARES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *shares], ["doc_id", *_MEASURES, *_SHARES])


def quality(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: counts, shares, ``base_failed``, ``kept`` and ``reasons``.

    Null and empty texts have no words and fail the base rules.  ``reasons`` names
    the limits that the shares exceed, in a fixed order.  Of equally frequent n-grams
    the one that begins first in the text is the top one.  Every text is measured
    whole; columns other than doc_id and text are ignored.
    """
    schema = ", ".join(["doc_id long", *(f"{m} long" for m in _MEASURES), *(f"{s} double" for s in _SHARES)])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measured, schema)
    limits = {f"dup_{n}gram": x for n, x in MAX_DUPLICATE.items()} | {f"top_{n}gram": x for n, x in MAX_TOP.items()} | {"dup_lines": MAX_DUP_LINES, "dup_line_chars": MAX_DUP_LINE_CHARS, "symbols": MAX_SYMBOLS}
    reasons = F.array_compact(F.array(*(F.when(F.col(k) > x, F.lit(k)) for k, x in limits.items())))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumns({"base_failed": failed, "reasons": reasons}).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def op3(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *_MEASURES, "base_failed", "kept", *_SHARES)
