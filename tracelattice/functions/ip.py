"""Addresses: predicates, numbers, text and bucket ids.

IPv4 stays in built-in expressions.  IPv6 text needs a parser, so it goes through
Arrow batches; the 16 bytes of a BINARY column order as the number does.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


_HEX = "[0-9A-Fa-f]{1,4}"
_DOTTED = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """Eight groups, or fewer around one ``::``; the last two may be a dotted address."""
    forms = [f"({_HEX}:){{7}}{_HEX}", f"({_HEX}:){{6}}{_DOTTED}"]
    for k in range(8):
        head = f"{_HEX}(:{_HEX}){{{k - 1}}}" if k else ""
        tails = [f"({_HEX}(:{_HEX}){{0,{6 - k}}})?"] if k < 7 else [""]
        if k < 6:
            tails.append(f"({_HEX}:){{0,{5 - k}}}{_DOTTED}")
        forms.append(f"{head}::({'|'.join(tails)})")
    return f"^({'|'.join(forms)})$"


IPV6 = _ipv6_pattern()


def is_ipv6(text: Column) -> Column:
    return F.coalesce(text.contains(":") & text.rlike(IPV6), F.lit(False))


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text.rlike(IPV4), F.lit(False))


def checked_ipv4_number(text: Column) -> Column:
    """The LONG of a text that is known to be an IPv4 address."""
    octet = lambda i: F.substring_index(F.substring_index(text, ".", i), ".", -1).cast("long")
    return octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)


def ipv4_number(text: Column) -> Column:
    """The address as LONG; null where the text is none."""
    return F.when(is_ipv4(text), checked_ipv4_number(text))


def ipv4_text(number: Column) -> Column:
    """Dotted text; null outside 0 to 2**32 - 1."""
    part = lambda bits: F.shiftright(number, bits).bitwiseAND(F.lit(255)).cast("string")
    return F.when(number.between(0, 4294967295), F.concat_ws(".", part(24), part(16), part(8), part(0)))


@pandas_udf(BinaryType())
def ipv6_bytes(text: pd.Series) -> pd.Series:
    """The address as 16 bytes; null where the text is none (zones are none)."""

    def parsed(x):
        try:
            return ipaddress.IPv6Address(x).packed if x is not None and "%" not in x else None
        except ValueError:
            return None

    return text.map(parsed, na_action=None)


@pandas_udf(StringType())
def ipv6_text(packed: pd.Series) -> pd.Series:
    """Compressed text of 16 bytes."""
    return packed.map(lambda b: None if b is None else str(ipaddress.IPv6Address(bytes(b))))


def ipv6_high(packed: Column) -> Column:
    """The first eight bytes as an unsigned number."""
    return F.conv(F.hex(F.substring(packed, 1, 8)), 16, 10).cast("decimal(20,0)")


def ipv6_low(packed: Column) -> Column:
    return F.conv(F.hex(F.substring(packed, 9, 8)), 16, 10).cast("decimal(20,0)")


def bucket_v4(number: Column) -> Column:
    """Second octet XOR fourth octet."""
    return F.shiftright(number, 16).bitwiseAND(F.lit(255)).bitwiseXOR(number.bitwiseAND(F.lit(255))).cast("int")


def bucket_v6(packed: Column) -> Column:
    """Eighth byte XOR sixteenth byte."""
    byte = lambda i: F.conv(F.hex(F.substring(packed, i, 1)), 16, 10).cast("int")
    return byte(8).bitwiseXOR(byte(16))


def address_number(kind: Column, packed: Column) -> Column:
    """IPv4 and IPv6 bytes in one space: 16 bytes, shorter ones padded on the left; null for other kinds."""
    return F.when(kind.isin("ipv4", "ipv6"), F.lpad(packed, 16, F.lit(b"\x00")))
