"""WARC archives under Zstandard with an embedded dictionary.

An archive is a skippable frame that holds the dictionary, then one frame for each
record, so that a record can be read by its offset alone.  The dictionary is built
from the archive's own records.  Of records with equal payloads one is a response
and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, filesystem, partitions_for, remove_folder, shared_folder, table

#: Uncompressed bytes after which an archive is closed; a longer record has one of its own.
ARCHIVE_BYTES = 24 << 20
#: Bytes of the dictionary and of the records that train it.
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 4 << 20
LEVEL = 3
#: Fixed values of the formats.
SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _header(value: object) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in str(value))


def record(kind: str, page_id: int | None, url: str | None, sha1: bytes, length: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the full payload's length and has no payload.

    A record is named by its page: pages with equal or no page_id share a WARC-Record-ID.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header(url) if url is not None else f'urn:page:{name}'}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the records' own beginning where they are too few to train one."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = [r[: 128 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[: DICTIONARY_BYTES // 4] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], out) -> None:
    """Writes the dictionary's frame and each record's frame to an open binary stream."""
    dictionary = build_dictionary(records)
    raw = dictionary.as_bytes()
    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    for r in records:
        out.write(packer.compress(r))


def frame_end(data: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from its headers alone."""
    magic, flags = struct.unpack_from("<IB", data, at)
    if magic != FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at {at}")
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * (flags >> 2 & 1)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        yield unpacker.decompress(data[at:end])
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC fields, HTTP fields and payload."""
    fields = lambda part: dict(line.split(": ", 1) for line in part.decode().split("\r\n")[1:])
    head, rest = raw.split(b"\r\n\r\n", 1)
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def plan(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """(page_id, url, kind, refers_to, sha1, length, payload) of the records to write.

    Of equal payloads of at least ``smallest`` bytes the row of the largest page_id
    is the response (rows that repeat that page_id are responses too); shorter
    payloads are always responses.  Null html is an empty payload.  Rows without a
    page_id are revisits if any row of their group has one, otherwise responses.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("length"))
    first = checkpoint(rows.groupBy("sha1", "length").agg(F.max("page_id").alias("first")))
    rows = rows.join(first, ["sha1", "length"])
    again = (F.col("length") >= smallest) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"), "sha1", "length", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        size = count = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, count
            name = f"part-{task.partitionId():05d}-{count:05d}-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}") as out:
                write_archive(held, out)
            made = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(held)], pa.int64())})
            held, size, count = [], 0, count + 1
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, kind, refers, sha1, length, payload = (c[i].as_py() for c in batch.columns)
                made = record(kind, page, url, bytes.fromhex(sha1), length, payload, refers)
                if held and size + len(made) > ARCHIVE_BYTES:
                    yield close()
                held.append(made)
                size += len(made)
        if held:
            yield close()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    number = lambda urn: int(x) if (x := urn.strip("<>").rpartition(":")[2]) else None
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, place = filesystem(path)
            with fs.open_input_stream(place) as f:
                data = f.read()
            rows: list[tuple] = []
            for raw in read_archive(data):
                warc, http, payload = parse(raw)
                length, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")
                if warc["WARC-Type"] == "response":
                    if length != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: the payload of {warc['WARC-Record-ID']} is damaged")
                refers = warc.get("WARC-Refers-To")
                rows.append((number(warc["WARC-Record-ID"]), length, digest, warc["WARC-Type"], number(refers) if refers else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write(pages: DataFrame, folder: str, smallest: int = 0) -> DataFrame:
    """Writes the archives below ``folder``, a URI that all executors reach; (path, records) of each.

    A task that runs again writes under new names; only the returned paths count.
    An empty table writes nothing.
    """
    return checkpoint(plan(pages, smallest).mapInArrow(_writer(folder), "path string, records long"))


def read(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in column ``path``; damaged payloads are an error."""
    paths = archives.select("path").repartition(partitions_for(archives.sparkSession), "path")
    return paths.mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    found = checkpoint(read(write(table(spark, sf_dir, "pages"), folder)))
    remove_folder(spark, folder)
    return found
