"""Byte-level BPE by backtracking over longest matches, and decoding by offsets.

A piece of text is encoded from left to right with the longest token that an
Aho-Corasick pass found at each position.  A token may follow another only if
merging would never cross their border; the pair table decides that.  When no
longest token fits, the encoder takes the next shorter prefix token, or steps
back by one token.  Positions that proved a dead end are never entered again, so
the time is linear in the piece and the result equals the merge order's.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table

VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's own rule for pieces of text (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces that a worker remembers in each of two generations: when the young one is full, it becomes
#: the old one, and pieces met again move back.
REMEMBERED = 300_000
#: Bytes of the longest piece that is remembered.
REMEMBERED_BYTES = 64


def _printable_bytes() -> dict[str, int]:
    """The vocabulary file writes each byte as a printable character: itself, or 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with one vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _printable_bytes()
        spelled = lambda s: bytes(back[c] for c in s)
        vocab = {spelled(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.spelling = [b""] * self.size
        for token, i in vocab.items():
            self.spelling[i] = token
        for content, i in self.special.items():
            self.spelling[i] = content.encode()
        # the pair table: (left, right) -> (rank, merged); parts: merged -> its halves
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.rank = [-1] * self.size
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(spelled, merge.split(" ") if isinstance(merge, str) else merge)
            pair, merged = (vocab[left], vocab[right]), vocab[left + right]
            self.pairs.setdefault(pair, (rank, merged))
            if self.parts[merged] is None:
                self.parts[merged], self.rank[merged] = pair, rank
        self.machine = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.machine.add_word(token.decode("latin-1"), (len(token), i))
        self.machine.make_automaton()
        self.shorter = [-1] * self.size  # longest proper prefix that is a token
        for token, i in vocab.items():
            for end in range(len(token) - 1, 0, -1):
                if (p := vocab.get(token[:end])) is not None:
                    self.shorter[i] = p
                    break
        self.offsets = np.cumsum([0, *map(len, self.spelling)])
        self.bytes = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.ids = vocab
        self.pieces = regex.compile(PIECES)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.compatible: dict[int, bool] = {}
        self.memory: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens; each answer is kept in a table."""
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # undo the merges of both tokens at the border, latest first; before each of
        # them, a merge of the border pair must not have been due
        due = 1 << 60
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across[0] < due:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was made last; of equal merges the left one goes first
                due, left = a, self.parts[left][1]
            else:
                due, right = b + 1, self.parts[right][0]

    def piece(self, raw: bytes) -> list[int]:
        """The token ids of one piece."""
        if (whole := self.ids.get(raw)) is not None and len(raw) == 1:
            return [whole]
        n = len(raw)
        longest = [-1] * n
        for end, (size, token) in self.machine.iter(raw.decode("latin-1")):
            longest[end - size + 1] = token  # ends only grow, so the longest comes last
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        spelling, shorter, fits = self.spelling, self.shorter, self.fits
        while True:
            end = at + len(spelling[token])
            if alive[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here: the place is dead, take back one token
                alive[at] = 0
                last = out.pop()
                at -= len(spelling[last])
                token = shorter[last]

    def _known(self, piece: str) -> tuple[bytes, str]:
        """Ids of a piece that the young generation lacks."""
        found = self.memory.get(piece) or self.older.get(piece)
        if found is None:
            ids = self.piece(piece.encode("utf-8"))
            found = (array("i", ids).tobytes(), ",".join(map(str, ids)))
        if len(piece) <= REMEMBERED_BYTES:
            if len(self.memory) >= REMEMBERED:
                self.older, self.memory = self.memory, {}
            self.memory[piece] = found
        return found

    def encode_parts(self, text: str, marks: bool = True) -> tuple[list[bytes], list[str]]:
        """Ids as int32 bytes, and as decimals joined by commas, piece by piece."""
        all_found: list[tuple[bytes, str]] = []
        for k, part in enumerate(self.marks.split(text) if marks and self.marks else [text]):
            if k % 2:
                i = self.special[part]
                all_found.append((array("i", [i]).tobytes(), str(i)))
                continue
            pieces = self.pieces.findall(part)
            found = list(map(self.memory.get, pieces))
            if None in found:
                known = self._known
                found = [known(p) if f is None else f for p, f in zip(pieces, found)]
            all_found += found
        return [f[0] for f in all_found], [f[1] for f in all_found]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_parts(text or "")[0]), np.int32)

    def encode_ordinary(self, text: str | None) -> np.ndarray:
        """As ``encode``, but special tokens' strings are ordinary text."""
        return np.frombuffer(b"".join(self.encode_parts(text or "", marks=False)[0]), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from one table by their offsets."""
        ids = np.asarray(ids, np.int64)
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)]
            sizes = self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(sizes)
            if len(ends):
                shift = np.repeat(self.offsets[part] - (ends - sizes), sizes)
                out.append(self.bytes[np.arange(ends[-1]) + shift].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())
        for batch in batches:
            n, sha, back = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                parts, shown = coder.encode_parts(text)
                ids = np.frombuffer(b"".join(parts), np.int32)
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(shown).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())
        for batch in batches:
            ids = [coder.encode(t.as_py()) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; null and empty texts have none."""
    return _source(docs).mapInArrow(_tokens(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or vocabulary_path())
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of ``docs``.

    Null texts count as empty; repeated rows are encoded each; a special token's
    string in a text becomes that token, as in the library's own default.
    """
    return _source(docs).mapInArrow(_encoded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
