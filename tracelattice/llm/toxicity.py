"""Toxicity: a learned lexicon, matched through Levenshtein automata over its trie.

Training looks at a bounded sample of labelled rows.  Word prefixes and whole words
that toxic documents use far more often than others become terms.  The trie of the
terms is intersected with the Levenshtein automata of their allowed edit distances;
the product is made deterministic lazily, state by state, so that a word costs one
step a letter and most words die after a few.  Each hit is weighed by its context
window: quotation marks around it and reporting words before it count towards
quotation, the rest towards abuse.  A logistic model over these sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, packed, table, unpacked

#: Most labelled rows that training looks at: those with the smallest hashes of doc_id.
TRAINING_ROWS = 20_000
#: Most terms of the lexicon, and most prefixes and words that are looked at for it, by toxic documents.
MAX_TERMS, MAX_KEYS = 500, 20_000
#: Prefix lengths that may become terms; letters of the longest word that may.
PREFIXES, LONGEST = range(3, 11), 40
#: A term occurs in at least so many toxic documents of the sample, and this share of them.
MIN_DOCS, MIN_SHARE = 5, 0.004
#: Natural log of the smallest ratio between a term's rates in toxic and in other documents.
MIN_LOG_ODDS = 3.0
#: Words before a hit that are searched for reporting words.
WINDOW = 6
#: Words that announce a quotation.
REPORTING = frozenset(
    "said says say saying called calls call wrote writes quote quoted quotes word words term terms phrase insult insults slur slurs reported "
    "sagte sagt schrieb nannte nennt wort zitat begriff dit disait appelé mot terme citation écrit dijo dice llamó palabra término cita escribió".split()
)
#: Words that a worker remembers; beyond that the memory starts anew.
REMEMBERED = 400_000
#: States of the product automaton that are kept; beyond that it is built anew.
STATES = 50_000

#: Letters and digits, with signs that stand for letters between them.
_WORDS = re.compile(r"[^\W_](?:[\w*@$#!+]*[^\W_])?")
_OPEN, _CLOSE = "“«„‹", "”»‟›"


def allowed_edits(length: int, masked: bool = False) -> int:
    """By a term's length; a short term may differ by one if the word is masked, that is has a digit or sign in it."""
    return int(masked) if length < 5 else 1 if length < 10 else 2


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool


class Matcher:
    """The product of a trie and the Levenshtein automata of its terms."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, term in enumerate(terms):
            node = 0
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(k)
        # edits that still make sense below a node
        self.most = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            self.most[node] = max([*(allowed_edits(len(terms[k].text), True) for k in self.ends[node]), *(self.most[n] for n in self.children[node].values())], default=0)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[frozenset, tuple | None, bool]] = []
        self.steps: list[dict[str, int]] = []
        self.memory: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({0: 0}, None, False)

    def _state(self, front: dict[int, int], best: tuple | None, masked: bool) -> int:
        """The number of a state: reachable trie nodes with their fewest edits, the best prefix match, and whether a letter was masked."""
        work = sorted(front.items(), key=lambda x: x[1])
        while work:  # letters of the term that the word leaves out
            node, e = work.pop()
            if front.get(node) == e:
                for n in self.children[node].values():
                    if e + 1 <= self.most[n] and front.get(n, 99) > e + 1:
                        front[n] = e + 1
                        work.append((n, e + 1))
        for node, e in front.items():
            for k in self.ends[node]:
                if self.terms[k].prefix and e <= allowed_edits(len(self.terms[k].text), masked):
                    best = min(best or (99, 0), (e, k))
        key = (frozenset(front.items()), best, masked)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        nodes, best, masked = self.states[state]
        front: dict[int, int] = {}
        for node, e in nodes:
            if e + 1 <= self.most[node] and front.get(node, 99) > e + 1:
                front[node] = e + 1  # an extra letter in the word
            for letter, n in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[n] and front.get(n, 99) > cost:
                    front[n] = cost
        return self._state(front, best, masked or not c.isalpha())

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best match, fewest edits first; None if no term is near enough."""
        state = self.start
        for c in word:
            following = self.steps[state].get(c)
            if following is None:
                if len(self.states) > STATES:
                    self._reset()
                    return self.match(word)
                following = self.steps[state][c] = self._step(state, c)
            state = following
            if not self.states[state][0]:
                break
        nodes, best, masked = self.states[state]
        for node, e in nodes:
            for k in self.ends[node]:
                if e <= allowed_edits(len(self.terms[k].text), masked):
                    best = min(best or (99, 0), (e, k))
        return best

    def known(self, word: str) -> tuple[int, int] | None:
        memory = self.memory
        if word in memory:
            return memory[word]
        if len(memory) >= REMEMBERED:
            memory.clear()
        found = self.match(word)
        self.memory[word] = found
        return found


FEATURES = ["exact_abuse", "fuzzy_abuse", "exact_quoted", "fuzzy_quoted", "n_words"]


class Quotations:
    """Whether places of a text, asked in rising order, lie within quotation marks of their line; each letter is passed once."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self._new_line()

    def _new_line(self) -> None:
        self.straight, self.opened, self.closed = 0, [-1] * len(_OPEN), [-1] * len(_CLOSE)

    def inside(self, place: int) -> bool:
        line = self.text.rfind("\n", self.at, place)
        if line >= 0:
            self.at = line + 1
            self._new_line()
        self.straight += self.text.count('"', self.at, place)
        for marks, last in ((_OPEN, self.opened), (_CLOSE, self.closed)):
            for k, mark in enumerate(marks):
                last[k] = max(last[k], self.text.rfind(mark, self.at, place))
        self.at = place
        return self.straight % 2 == 1 or any(o > c for o, c in zip(self.opened, self.closed))


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Sums over the hits of a whole text, and its number of words.

    A hit counts from 0 (the writer's own words) to 1 (a quotation): 0.75 within
    quotation marks, 0.4 for each reporting word among the WINDOW before it.
    """
    lower = (text or "").lower()
    words = _WORDS.findall(lower)
    out = [0.0, 0.0, 0.0, 0.0, float(len(words))]
    hits = {w: found for w in set(words) if (found := matcher.known(w))}
    if hits:
        before: list[str] = []
        quotations = Quotations(lower)
        for m in _WORDS.finditer(lower):
            word = m[0]
            if word in hits:
                quoted = min(1.0, 0.75 * quotations.inside(m.start()) + 0.4 * sum(w in REPORTING for w in before))
                fuzzy = hits[word][0] > 0
                out[fuzzy] += 1 - quoted
                out[2 + fuzzy] += quoted
            before.append(word)
            if len(before) > WINDOW:
                del before[0]
    return out


def _design(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).reshape(-1, len(FEATURES))
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, :4]), np.minimum(x[:, :4], 1), np.log1p(x[:, 4]) / 10])


@dataclass
class Model:
    """Terms and weights; ``predict`` maps features to scores from 0 to 1."""

    terms: list[Term] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-20.0] + [0.0] * 9)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(x) @ np.array(self.weights), -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> list[float]:
    """Ridge logistic regression by damped Newton steps."""
    d, y = _design(x), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.01) / (len(y) + 1) if len(y) else 1e-9
        return [math.log(rate / (1 - rate)), *[0.0] * (d.shape[1] - 1)]
    keep = np.full(d.shape[1], ridge)
    keep[0] = 1e-6
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (d @ w)).sum() + (keep * w * w).sum() / 2
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope, curve = d.T @ (p - y) + keep * w, (d * (p * (1 - p))[:, None]).T @ d + np.diag(keep)
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(size * step).max() < 1e-8:
            break
    return w.tolist()


def select_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int, most: int = MAX_TERMS) -> list[Term]:
    """The lexicon from document counts (toxic, clean) of prefixes and of whole words (marked ``$``)."""
    need = max(MIN_DOCS, MIN_SHARE * toxic)

    def good(key: str) -> bool:
        a, b = counts.get(key, (0, 0))
        return a >= need and math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) >= MIN_LOG_ODDS

    chosen: dict[str, tuple[int, Term]] = {}
    prefixes = sorted((k for k in counts if not k.endswith("$") and good(k)), key=lambda k: (len(k), k))
    for p in prefixes:
        if len(p) > PREFIXES[0] and good(p[:-1]):
            continue
        text, n = p, counts[p][0]
        longer = [k for k in prefixes if k.startswith(p) and counts[k][0] >= 0.95 * n]
        text = max(longer, key=lambda k: (len(k), counts[k][0], k))
        words = [k[:-1] for k in counts if k.endswith("$") and k.startswith(text) and counts[k][0] >= 0.95 * n]
        term = Term(max(words, key=lambda w: (counts[w + "$"][0], w)), False) if words else Term(text, True)
        chosen[term.text] = (n, term)
    for k in counts:  # words whose prefixes are common elsewhere
        if k.endswith("$") and good(k) and k[:-1] not in chosen and not any(k.startswith(t) for t, (_, x) in chosen.items() if x.prefix):
            if not any(good(k[:i]) for i in range(PREFIXES[0], len(k))):
                chosen[k[:-1]] = (counts[k][0], Term(k[:-1], False))
    return [t for _, t in sorted(chosen.values(), key=lambda x: (-x[0], x[1].text))[:most]]


def _keys(text: str | None) -> set[str]:
    keys: set[str] = set()
    for w in set(_WORDS.findall((text or "").lower())):
        keys.update(w[:i] for i in PREFIXES if i <= len(w))
        if PREFIXES[0] <= len(w) <= LONGEST:
            keys.add(w + "$")
    return keys


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = list({*counts[0], *counts[1]})
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[i][k] for k in keys], pa.int64()) for i in (1, 0))], ["key", "toxic", "clean"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[label].update(_keys(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    yield flush()


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents outside the held-out fifth.

    Conflicting labels of a document count as toxic; null labels and ids take no part;
    of rows that repeat a doc_id the smallest text counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna()
    known = known.where(F.crc32(F.col("label_id").cast("string")) % 5 != 0).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "label_id")
    return texts.groupBy("label_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _features_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in batches:
            found = np.array([features(t.as_py(), matcher) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], ["key", *FEATURES])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    """A model from the training rows; without labels of both kinds it scores the base rate."""
    rows = checkpoint(training_rows(docs, labels, most))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.mapInArrow(_counted, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    near = counts.where((F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * toxic)) & (F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1)) >= MIN_LOG_ODDS - 1e-9))
    best = near.orderBy(F.desc("toxic"), "clean", "key").limit(MAX_KEYS).collect()
    model = Model(select_terms({r["key"]: (r["toxic"], r["clean"]) for r in best}, toxic, clean))
    found = rows.select(F.col("toxic").alias("key"), "text").mapInArrow(_features_of(model), "key int, " + ", ".join(f"{f} double" for f in FEATURES)).collect()
    model.weights = fit_weights(np.array([r[1:] for r in found], float), np.array([r[0] for r in found]))
    return model


def _scored(model: Model, column: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in batches:
            found = np.array([features(t.as_py(), matcher) for t in batch.column(column)]).reshape(-1, len(FEATURES))
            scores = model.predict(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], [*names, "score", *FEATURES])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, and the sums behind it), a row for each row of ``docs``.

    Null and empty texts have no hits and get the score of a text without words.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text string, score double, " + ", ".join(f"{f} double" for f in FEATURES)
    return source.mapInArrow(_scored(model, 1, ["doc_id", "text"]), schema).drop("text")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in batches:
            texts = batch.column(0).field(at)
            found = np.array([features(t.as_py(), matcher) for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.predict(found) < threshold))

    rows = packed(docs)
    rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*unpacked(rows, docs.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)
