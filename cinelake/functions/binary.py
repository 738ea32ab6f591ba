"""Column helpers over BINARY values. Offsets are 0-based; a read past the end is NULL."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def literal_table(value, ddl: str) -> Column:
    """A nested constant as one foldable expression (thousands of small literals would dominate plan building)."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def let(value: Column, fn) -> Column:
    """Evaluate a value once and use it many times (a CASE would otherwise repeat it in every branch)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def size_of(content: Column | str) -> Column:
    return F.octet_length(col(content)).cast("long")


def slice_bytes(content: Column | str, offset, length) -> Column:
    return F.substring(col(content), (lit(offset) + 1).cast("int"), lit(length).cast("int"))


def hex_slice(content: Column | str, offset, width: int) -> Column:
    """Upper-case hex of exactly `width` bytes, NULL when fewer remain."""
    h = F.hex(slice_bytes(content, offset, width))
    return F.when(F.length(h) == 2 * width, h)


def uint(content: Column | str, offset, width: int, endian: str = "be") -> Column:
    """Unsigned integer of 1 to 8 bytes as LONG (NULL from 2^63 on)."""
    if endian == "le" and width > 1:
        h = F.concat(*[F.hex(slice_bytes(content, lit(offset) + i, 1)) for i in reversed(range(width))])
    else:
        h = F.hex(slice_bytes(content, offset, width))
    v = F.conv(h, 16, 10)
    v = v.cast("long") if width < 8 else v.cast("decimal(20,0)").try_cast("long")
    return F.when(size_of(content) >= lit(offset) + width, v)


def uint_upto(content: Column | str, offset, width: int) -> Column:
    """Big-endian unsigned integer of the at most `width` (7 or fewer) bytes that are there; NULL when none is."""
    return F.conv(F.hex(slice_bytes(content, offset, width)), 16, 10).cast("long")


def uint_var(content: Column, offset: Column, width: Column, little: Column) -> Column:
    """`uint` with the layout taken from columns (one expression for a whole rule table)."""
    h = F.hex(F.substring(content, (offset + 1).cast("int"), width.cast("int")))
    swapped = let(F.rpad(h, 16, "0"), lambda x: F.concat(*[F.substring(x, 2 * i + 1, 2) for i in reversed(range(8))]))
    v = F.conv(F.when(little, swapped).otherwise(h), 16, 10).cast("decimal(20,0)").try_cast("long")
    return F.when(size_of(content) >= offset + width, v)


def sint(content: Column | str, offset, width: int, endian: str = "be") -> Column:
    """Two's-complement integer of 1 to 4 bytes."""
    u = uint(content, offset, width, endian)
    half, full = 1 << (8 * width - 1), 1 << (8 * width)
    return F.when(u >= half, u - F.lit(full)).otherwise(u)


def bytes_at(content: Column | str, offset, expected: bytes) -> Column:
    return slice_bytes(content, offset, len(expected)) == F.lit(bytearray(expected))


def contains_bytes(content: Column | str, needle: bytes) -> Column:
    return F.contains(col(content), F.lit(bytearray(needle)))


def bits(value: Column | str, shift: int, mask: int) -> Column:
    return F.shiftright(col(value), shift).bitwiseAND(F.lit(mask))


def le_hex(value: Column | str, width: int) -> Column:
    """Little-endian two's-complement hex text of an integer; join these with listagg, then unhex once."""
    h = F.lpad(F.hex(col(value).cast("long").bitwiseAND(F.lit((1 << (8 * width)) - 1).cast("long"))), 2 * width, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def be_hex(value: Column | str, width: int) -> Column:
    return F.lpad(F.hex(col(value).cast("long").bitwiseAND(F.lit((1 << (8 * width)) - 1).cast("long"))), 2 * width, "0")
