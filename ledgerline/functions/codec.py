"""Portable encodings of single values, as column expressions: no Python runs.

Fixed-width integers are big-endian; signed variable-width ones are zig-zag coded; strings and binaries carry their
length as a variable-width integer. Unsigned 64-bit values are decimals of 20 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 20


def fixed(value: Column, width: int) -> Column:
    """``value`` as ``width`` big-endian bytes, two's complement; null and out-of-range values are null."""
    if width not in (1, 2, 4, 8):
        raise ValueError("width must be 1, 2, 4 or 8")
    fits = value.isNotNull() if width == 8 else (value >= -(1 << (8 * width - 1))) & (value < 1 << (8 * width))
    return F.when(fits, F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)))


def from_fixed(data: Column, signed: bool = True) -> Column:
    """A long from up to 8 big-endian bytes; unsigned 8-byte values are decimal(20,0)."""
    unsigned = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    if not signed:
        return unsigned
    span = F.coalesce(*(F.when(F.octet_length(data) == n, F.lit(str(1 << (8 * n))).cast("decimal(21,0)")) for n in range(1, 9)))
    return F.when(unsigned * 2 >= span, unsigned - span).otherwise(unsigned).cast("long")


def zigzag(value: Column) -> Column:
    """Small magnitudes to small numbers: 0, -1, 1, -2 to 0, 1, 2, 3. The result is the bit pattern of an unsigned long."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def from_zigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-(value.bitwiseAND(1)))


def varint(value: Column) -> Column:
    """Seven bits a byte, least first, the high bit on all but the last; ``value`` is an unsigned long's bit pattern."""
    count = F.when(value == 0, 1).otherwise(F.ceil(F.length(F.regexp_replace(F.bin(value), "^0+", "")) / 7)).cast("int")
    digits = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", value, 7 * i).bitwiseAND(127).bitwiseOR(F.when(i < count - 1, 128).otherwise(0))), 2, "0"))
    return F.when(value.isNotNull(), F.unhex(F.array_join(digits, "")))


def from_varint(data: Column) -> Column:
    """The unsigned long's bit pattern; null if the last byte says that more follow."""
    n = F.octet_length(data)
    byte = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda x, i: x.bitwiseOR(F.call_function("shiftleft", byte(i).bitwiseAND(127), 7 * (i - 1))))
    return F.when((n > 0) & (byte(n) < 128), total)


def sized(value: Column) -> Column:
    """A string's or binary's length and bytes; longer ones than ``LIMIT`` bytes are refused when written."""
    data = value.cast("binary")
    size = F.octet_length(data).cast("long")
    return F.when(size > LIMIT, F.raise_error(F.lit(f"value is longer than {LIMIT} bytes")).cast("binary")).otherwise(F.concat(varint(size), data))


def from_sized(data: Column) -> Column:
    """The binary that ``sized`` holds; null if bytes are missing."""
    head = F.regexp_extract(F.hex(data), "^((?:[89A-F][0-9A-F])*[0-7][0-9A-F])", 1)
    size = from_varint(F.unhex(head))
    start = (F.length(head) / 2).cast("int")
    return F.when(F.octet_length(data) - start >= size, F.substring(data, start + 1, size.cast("int")))


def checked_uint32(value: Column) -> Column:
    """The value as long; null beyond 0 to 2^32 - 1."""
    return F.when(value.between(0, (1 << 32) - 1), value.cast("long"))


def boolean(value: Column) -> Column:
    """One byte, 0 or 1."""
    return F.when(value, F.unhex(F.lit("01"))).when(~value, F.unhex(F.lit("00")))


def from_boolean(data: Column) -> Column:
    """True or false; null for what is neither."""
    return F.when(F.hex(data) == "01", F.lit(True)).when(F.hex(data) == "00", F.lit(False))


def section(data: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` raw bytes from ``start`` (0 is the first) on; null if there are not so many."""
    start, length = (F.lit(x) if isinstance(x, int) else x for x in (start, length))
    return F.when((start >= 0) & (length >= 0) & (start + length <= F.octet_length(data)), F.substring(data, (start + 1).cast("int"), length.cast("int")))


def strictly(decoded: Column, data: Column, what: str) -> Column:
    """``decoded``, which is an error where it is null though ``data`` is not: bytes are missing or out of range."""
    return F.when(decoded.isNull() & data.isNotNull(), F.raise_error(F.lit(f"bad {what}"))).otherwise(decoded)
