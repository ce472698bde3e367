"""Token sequences in training order: a keyed Feistel permutation and fixed-stride shards.

Texts become token ids, an end mark follows each text, and the stream of every
input partition is cut into sequences of fixed length.  A first pass counts the
sequences of each partition; the counts give every sequence a number from 0 to N-1.
A Feistel network over the next even power of two, walked until it lands below N,
permutes the numbers: its output is the sequence's slot in the training order.
Slots are dealt out by range, and each range is written as one shard in which slot
s stands at a fixed offset, so reading is sequential and can resume at any slot.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, filesystem, remove_folder, shared_folder, table

#: Tokens of a sequence, slots of a shard, the key of the order.
LENGTH, SLOTS, KEY = 2048, 2048, 20240607
VOCABULARY, END = "byte_bpe_50k.tiktoken", 50256
ROUNDS = 6
_WIDTH = 2  # bytes of a token


def feistel(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permutation of 0..n-1 under ``key``, applied to ``numbers``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def mixed(x: np.ndarray, r: int) -> np.ndarray:
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(a))) * np.uint64(m)
        return x ^ (x >> np.uint64(31))

    out = np.asarray(numbers, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):  # cycle walking: repeat until the output lies in the domain
        left, right = out[walking] >> shift, out[walking] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mixed(right, r) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


#: The vocabulary's rule for pieces of text, with possessive repeats (fixed value).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: White space in a row that the fast encoder's stack can't hold for certain.
_GAP = re.compile(r"\s{4096}")


@lru_cache(maxsize=2)
def _tiktoken(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(*ranks.values(), END) >= 1 << 8 * _WIDTH or END in ranks.values():
        raise ValueError(f"{path}: ids must fit {_WIDTH} bytes and leave {END} to the end mark")
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END})


def text_tokens(column: pa.Array, path: str | None) -> Iterator[np.ndarray]:
    """Ids of each text, special tokens' strings as ordinary text; null and empty texts have none.

    A text with very long white space goes to the backtracking encoder, which gives
    the same ids without recursion.
    """
    from .bpe import encoder, vocabulary_path

    encode = _tiktoken(path or vocabulary_path(VOCABULARY)).encode_to_numpy  # without a Python number for each token
    for text in column.to_numpy(zero_copy_only=False):
        if text is not None and len(text) > 4096 and _GAP.search(text):
            yield encoder(vocabulary_path()).encode_ordinary(text)
        else:
            yield encode(text or "", disallowed_special=())


def _counter(length: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total += sum(len(ids) + 1 for ids in text_tokens(batch.column(1), path))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": pa.array([total], pa.int64())})

    return run


_SPANS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("tokens", pa.int32())]))


def _sequencer(first: dict[int, int], counts: dict[int, int], n: int, length: int, slots: int, key: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1)
        held, mark = np.empty(0, np.uint16), np.array([END], np.uint16)
        spans: list[dict] = []
        at = seen = 0

        def rows(ready: list[tuple[np.ndarray, int, list[dict]]]) -> pa.RecordBatch:
            nonlocal at
            numbers = first.get(part, 0) + at + np.arange(len(ready))
            at += len(ready)
            order = feistel(numbers, n, key)
            return pa.RecordBatch.from_arrays([
                pa.array((order // slots).astype(np.int32)), pa.array(order), pa.array(numbers.astype(np.int64)), pa.array([r[1] for r in ready], pa.int32()),
                pa.array([pack.compress(r[0].tobytes()) for r in ready], pa.binary()), pa.array([r[2] for r in ready], _SPANS)
            ], ["shard", "slot", "sequence", "n_tokens", "data", "documents"])

        for batch in batches:
            parts, ready = [held], []
            filled = len(held)
            for doc, ids in zip(batch.column(0).to_pylist(), text_tokens(batch.column(1), path)):
                parts += (ids.astype(np.uint16), mark)
                rest = len(ids) + 1
                seen += rest
                while rest:
                    take = min(length - filled, rest)
                    spans.append({"doc_id": doc, "start": filled, "tokens": take})
                    rest -= take
                    filled += take
                    if filled == length:
                        ready.append(spans)
                        filled, spans = 0, []
            stream = np.concatenate(parts)
            whole = len(ready) * length
            held = stream[whole:].copy()
            for k in range(0, len(ready), 512):
                some = ready[k : k + 512]
                yield rows([(stream[(k + i) * length : (k + i + 1) * length], length, x) for i, x in enumerate(some)])
        if len(held):
            yield rows([(np.concatenate([held, np.full(length - len(held), END, np.uint16)]), len(held), spans)])
        if seen != counts.get(part, 0):
            raise RuntimeError(f"partition {part} had {counts.get(part, 0)} tokens when counted and {seen} now: the input must be a table that is read alike each time")

    return run


def _writer(folder: str, length: int, slots: int):
    stride = length * _WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, now, expected, draft = None, -1, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{root}/{draft}", f"{root}/{shard_name(now)}")

        for batch in batches:
            shards, order = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sums = []
            for shard, slot, data in zip(shards, order, batch.column(4)):
                if shard != now:
                    close()
                    now, expected, draft = shard, shard * slots, f"_draft-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{root}/{draft}")
                if slot != expected:
                    raise RuntimeError(f"shard {shard}: slot {slot} where {expected} is due")
                raw = unpack.decompress(data.as_py(), max_output_size=stride)
                out.write(raw)
                sums.append(zlib.crc32(raw))
                expected += 1
            offsets = (np.array(order, np.int64) % slots) * stride
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(offsets), pa.array(sums, pa.int64()), batch.column(5)], ["shard", "slot", "sequence", "n_tokens", "offset", "crc32", "documents"])
        close()

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


_ROWS = "shard int, slot long, sequence long, n_tokens int, offset long, crc32 long, documents array<struct<doc_id:bigint,start:int,tokens:int>>"


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY, path: str | None = None) -> DataFrame:
    """Writes the shards below ``folder``; a row for each sequence.

    Columns: shard, slot, sequence, n_tokens (the rest of the last sequence of an
    input partition is filled with end marks), offset in the shard, crc32 of the
    sequence's bytes, documents (doc_id, start, tokens of each piece in it).
    Tokens are two bytes, low byte first.  Null and empty texts contribute their end
    mark; null doc_ids stay null; repeated rows are written each; an empty table
    writes nothing.  ``docs`` must be a table scan or a checkpoint, which gives the
    same partitions on both passes; otherwise the second pass stops with an error.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {r["part"]: r["tokens"] for r in source.mapInArrow(_counter(length, path), "part int, tokens long").collect()}  # a row for each partition
    sizes = {p: -(-t // length) for p, t in sorted(counts.items())}
    first, n = {}, 0
    for p, size in sizes.items():
        first[p], n = n, n + size
    schema = "shard int, slot long, sequence long, n_tokens int, data binary, documents array<struct<doc_id:bigint,start:int,tokens:int>>"
    made = source.mapInArrow(_sequencer(first, counts, n, length, slots, key, path), schema)
    ranges = max(1, -(-n // slots))
    made = made.repartitionById(ranges, F.col("shard")).sortWithinPartitions("shard", "slot")
    return checkpoint(made.mapInArrow(_writer(folder, length, slots), _ROWS))


def read_shard(uri: str, length: int = LENGTH, skip: int = 0) -> Iterator[np.ndarray]:
    """The sequences of a shard in order, from its ``skip``-th on: one seek, then sequential reads."""
    fs, place = filesystem(uri)
    with fs.open_input_file(place) as f:
        f.seek(skip * length * _WIDTH)
        while len(raw := f.read(length * _WIDTH)) == length * _WIDTH:
            yield np.frombuffer(raw, "<u2")


def read_back(rows: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """``rows`` of ``materialise`` with ``read_crc32`` of what the shards hold at their offsets.

    The rows lie in the order of their slots, so each shard is read from its
    beginning; a row out of that order costs a seek.
    """
    stride = length * _WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        now, due, file = -1, 0, None
        for batch in batches:
            sums = []
            for shard, offset in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                if shard != now:
                    if file is not None:
                        file.close()
                    now, due, file = shard, 0, fs.open_input_file(f"{root}/{shard_name(shard)}")
                if offset != due:
                    file.seek(offset)
                sums.append(zlib.crc32(file.read(stride)))
                due = offset + stride
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "read_crc32"])
        if file is not None:
            file.close()

    return rows.mapInArrow(run, f"{_ROWS}, read_crc32 long")


def op2(spark, sf_dir: str) -> DataFrame:
    """A row for each sequence in the shards, in which ``read_crc32`` was read back from the files."""
    folder = shared_folder(spark, "shards")
    back = checkpoint(read_back(materialise(table(spark, sf_dir, "documents"), folder), folder))
    remove_folder(spark, folder)
    return back.select("slot", "shard", "offset", "sequence", "n_tokens", "crc32", "read_crc32", "documents")
