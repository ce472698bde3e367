from __future__ import annotations

import bz2
import gzip
import ipaddress
import struct

import pytest
from pyspark.sql import functions as F

from tracelattice.functions import ip
from tracelattice.sources import tables, warts, yarrp
from tracelattice.streaming.scan import stream_hops

from .test_paths import SCAN, scan


def test_listing_and_reading(spark, tmp_path):
    (tmp_path / "a.yarrp").write_bytes(SCAN.replace("\n", "\r\n").encode())
    (tmp_path / "b.yarrp.bz2").write_bytes(bz2.compress(SCAN.encode()))
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "c.yarrp").write_text("bad")
    for compressed in (False, True):
        lines = yarrp.read_lines(spark, f"file://{tmp_path}", compressed)
        assert [r["value"] for r in lines.orderBy("line_no").collect()] == SCAN.splitlines()
        assert yarrp.hops(lines).count() == 7
    (tmp_path / "empty").mkdir()
    assert yarrp.read_lines(spark, f"file://{tmp_path}/empty").count() == 0


BAD = {
    "1.1.1.1 1 2 11 0 abc 1.1.1.2 5 6": "ttl", "1.1.1.1 1 2 11 0 256 1.1.1.2 5 6": "ttl", "1.1.1.x 1 2 11 0 3 1.1.1.2 5 6": "ip", "1.1.1.1 1 2 11 0 3 1.1.1.02 5 6": "ip",
    "1.1.1.1 1 2 11 0 3 ::1 5 6": "family", "::2 1 2 11 0 3 ::1 5 6": "family", "1.1.1.1 1 2 11 0 3 1.1.1.2": "shape", "": "shape",
}


@pytest.mark.parametrize(("row", "reason"), BAD.items())
def test_rejects(spark, row, reason):
    lines = spark.createDataFrame([(row, "f", 0, 0)], "value string, file_name string, block_start long, line_no long")
    assert yarrp.parse(lines).first()["reason"] == reason
    assert yarrp.hops(lines, mode="permissive").count() == 0
    if reason == "ip":
        assert yarrp.hops(lines).count() == 0
    else:
        with pytest.raises(Exception, match="bad scan row"):
            yarrp.hops(lines).collect()


def test_six_family(spark):
    lines = scan(spark, "2001:db8::1 1 2 11 0 3 2001:db8:0:42::7 5 6")
    row = yarrp.hops(lines, "V6").first()
    assert bytes(row["hop"]) == ipaddress.IPv6Address("2001:db8:0:42::7").packed
    assert row["ttl"] == 3


def test_address_functions(spark):
    df = spark.createDataFrame([("10.0.0.1", "2001:db8:0:42::7", 167772162)], "a string, b string, n long")
    row = df.select(ip.ipv4_number(F.col("a")).alias("n"), ip.ipv4_text(F.col("n")).alias("t"), ip.bucket_v4(F.col("n")).alias("k"), ip.bucket_v6(ip.ipv6_bytes("b")).alias("s"), ip.ipv6_text(ip.ipv6_bytes("b")).alias("x")).first()
    assert tuple(row) == (167772161, "10.0.0.2", 2, 69, "2001:db8:0:42::7")


@pytest.mark.parametrize("text", ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7", "1::2::3", ":::", "g::", "1:2:3:4:5:6:7:8:9", "::1.2.3", "fe80::1%eth0", "12345::", "1:2:3:4:5:6:7::8"])
def test_six_predicate_equals_the_parser(spark, text):
    df = spark.createDataFrame([(text,)], "x string").select(ip.is_ipv6(F.col("x")).alias("a"), ip.ipv6_bytes("x").isNotNull().alias("b"))
    a, b = df.first()
    assert a == b


def _address(a: bytes) -> bytes:
    return bytes([len(a), {4: 1, 16: 2, 8: 4}[len(a)]]) + a


def _params(fields: dict[int, bytes], top: int) -> bytes:
    flags = bytearray(-(-top // 7))
    for f in fields:
        flags[(f - 1) // 7] |= 1 << (f - 1) % 7
    while len(flags) > 1 and not flags[-1]:
        flags.pop()
    for i in range(len(flags) - 1):
        flags[i] |= 0x80
    body = b"".join(fields[f] for f in sorted(fields))
    return bytes(flags) + (struct.pack(">H", len(body)) + body if fields else b"")


def _object(kind: int, body: bytes) -> bytes:
    return struct.pack(">HHI", 0x1205, kind, len(body)) + body


def _trace(src: bytes, hops: list[tuple[int, bytes]]) -> bytes:
    body = _params({5: b"\0" * 8, 10: b"\x20", 26: _address(src)}, 26) + struct.pack(">H", len(hops))
    seen = [src]
    for ttl, addr in hops:
        where = b"\0" + struct.pack(">I", seen.index(addr)) if addr in seen else _address(addr)
        if addr not in seen:
            seen.append(addr)
        body += _params({2: bytes([ttl]), 6: b"\0\0\1\0", 18: where}, 18)
    return _object(6, body + b"\0\0")


def test_binary_scans(spark, tmp_path):
    s, x, y = bytes([10, 0, 0, 9]), bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])
    data = _object(1, b"list") + _trace(s, [(1, x), (4, y), (5, b"12345678"), (6, x)]) + _trace(y, [(3, s)])
    import os as _os

    (tmp_path / "a.warts.gz").write_bytes(gzip.compress(data + _object(7, _os.urandom(200))))
    (tmp_path / "tiny.warts.gz").write_bytes(gzip.compress(_trace(s, [])))
    (tmp_path / "other.gz").write_bytes(b"no scan" * 30)
    records = warts.read_records(spark, f"file://{tmp_path}")
    assert [r["record_type"] for r in records.orderBy("record_no").collect()] == ["list", "traceroute", "traceroute", "ping"]
    first, second = warts.traces(records).orderBy("record_no").collect()
    assert bytes(first["src"]["addr"]) == s
    assert [(h["probe_ttl"], h["kind"], bytes(h["addr"])) for h in first["hops"]] == [(1, "ipv4", x), (4, "ipv4", y), (5, "firewire", b"12345678"), (6, "ipv4", x)]
    assert bytes(second["hops"][0]["addr"]) == s
    bad = _object(6, _params({5: b"\0" * 8}, 26) + struct.pack(">H", 0) + b"\0\0" + b"pad" * 60)
    (tmp_path / "b.warts.gz").write_bytes(gzip.compress(bad + _object(7, _os.urandom(200))))
    records = warts.read_records(spark, f"file://{tmp_path}")
    assert warts.traces(records, "permissive").count() == 2
    with pytest.raises(Exception, match="lacks its source"):
        warts.traces(records).collect()


def test_edge_tables(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,to\n1,2\nx,3\n4,5\n")
    assert sorted((r["from"], r["to"]) for r in tables.read_edges(spark, f"file://{tmp_path}/e.csv").collect()) == [(1, 2), (4, 5)]
    (tmp_path / "m.csv").write_text("known,unknown\n7,3\n1,1\n")
    assert tables.read_max_node_ids(spark, f"file://{tmp_path}/m.csv") == (7, 3)
    (tmp_path / "n.csv").write_text("known,unknown\n")
    with pytest.raises(ValueError):
        tables.read_max_node_ids(spark, f"file://{tmp_path}/n.csv")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.yarrp").write_text(SCAN)
        stream_hops(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(60)
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == 7 * (n + 1)


@pytest.mark.parametrize("family", ["V4", "V6"])
@pytest.mark.parametrize("mode", ["failfast", "permissive"])
def test_parsing_compiles(spark, family, mode):
    """The parser's code stays within the size that is compiled."""
    lines = spark.createDataFrame([("1.2.3.4 1 2 11 0 3 5.6.7.8 9 9" if family == "V4" else "::1 1 2 11 0 3 ::2 9 9",)], "value string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert yarrp.hops(lines, family, mode).count() == 1
        assert yarrp.hops(lines, family, mode).collect()[0]["ttl"] == 3
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")
