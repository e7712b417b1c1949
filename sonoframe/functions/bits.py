"""Bit fields of byte strings, most significant bit first, as column expressions over hexadecimal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_string(data: Column) -> Column:
    """Binary data as text of 0 and 1."""
    digits = F.array(*[F.lit(format(i, "04b")) for i in range(16)])
    each = F.transform(F.split(F.hex(data), ""), lambda c: F.get(digits, F.conv(c, 16, 10).cast("int")))
    return F.array_join(F.filter(each, lambda x: x.isNotNull()), "")


def unpack_bits(bits: Column, position: Column, count: Column) -> Column:
    """``count`` bits from ``position`` on as a number; what lies past the end is missing, not zero."""
    return F.when(count == 0, F.lit(0)).otherwise(F.coalesce(F.conv(F.substring(bits, position + 1, count), 2, 10).cast("long"), F.lit(0)))


def unpack_signed_bits(bits: Column, position: Column, count: Column) -> Column:
    raw = unpack_bits(bits, position, count)
    span = F.pow(F.lit(2), count).cast("long")
    return F.when((count > 0) & (2 * raw >= span), raw - span).otherwise(raw)


def reverse_low_bits(value: Column, count: int) -> Column:
    """The lowest ``count`` bits in reverse."""
    if count == 0:
        return F.lit(0).cast("long")
    low = F.lpad(F.conv(value.cast("string"), 10, 2), 64, "0")
    return F.conv(F.reverse(F.substring(low, 65 - count, count)), 2, 10).cast("long")


def channel_header(bits: Column) -> dict[str, Column]:
    """An independent channel's first byte: six bits of sync, two of unit mode."""
    sync, mode = (unpack_bits(bits, F.lit(a), F.lit(n)) for a, n in ((0, 6), (6, 2)))
    return {"sync": sync, "unit_count": mode + 1, "header_ok": sync == 0x28}


def joint_header(bits: Column) -> dict[str, Column]:
    """A joint second channel's two bytes: output selector, four hints, marker, unit mode."""
    field = lambda a, n: unpack_bits(bits, F.lit(a), F.lit(n))
    return {"selector": field(0, 4), "hints": F.array(field(4, 2), field(6, 2), field(8, 2), field(10, 2)), "marker_ok": field(12, 2) == 3, "unit_count": field(14, 2) + 1}


def pack_bits(fields: list[tuple[Column, int]]) -> Column:
    """Bytes of (value, bits) fields one after another, zeros behind the last one."""
    text = F.concat(*[F.substring(F.lpad(F.conv(value.cast("long").cast("string"), 10, 2), 64, "0"), 65 - bits, bits) for value, bits in fields])
    size = -(-sum(bits for _, bits in fields) // 8) * 8
    padded = F.rpad(text, size, "0")
    return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(padded, 1 + 8 * i, 8), 2, 16), 2, "0") for i in range(size // 8)]))


def counted_bits(fields: list[tuple[Column, int]]) -> int:
    return sum(bits for _, bits in fields)
