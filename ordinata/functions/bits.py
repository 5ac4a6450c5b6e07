"""Bit functions on LONG columns, and helpers for codes that pack several fields.

Symbols are unsigned integers below 2**32 and are held as LONG, so no shift meets a sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF


def _long(x: Column | int) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def unsigned(x: Column) -> Column:
    """The value of the lowest 32 bits."""
    return _long(x).bitwiseAND(F.lit(WORD).cast("long"))


def popcount(x: Column) -> Column:
    """Ones among the lowest 32 bits."""
    return F.bit_count(unsigned(x)).cast("long")


def trailing_zeros(x: Column) -> Column:
    """Zeros below the lowest one of 32 bits; 32 for zero."""
    v = unsigned(x)
    return F.when(v == 0, F.lit(32).cast("long")).otherwise(F.bit_count(v.bitwiseAND(-v) - 1).cast("long"))


def reverse_bits(x: Column, n: int = 32) -> Column:
    """The lowest n bits in reverse order, as an unsigned number."""
    if not 1 <= n <= 32:
        raise ValueError("n must be from 1 to 32")
    v = _long(x).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return F.conv(F.reverse(F.lpad(F.bin(v), n, "0")), 2, 10).cast("long")


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    return F.greatest(_long(low), F.least(_long(x), _long(high)))


def ceil_divide(x: Column, y: int) -> Column:
    """Of a positive divisor, in whole numbers: a double would lose digits beyond 2**53."""
    if y < 1:
        raise ValueError("y must be positive")
    v, d = _long(x), F.lit(y).cast("long")
    return F.call_function("div", v, d) + F.when(v % d > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")


def ones_array(x: Column) -> Column:
    """Places of the ones among the lowest 32 bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("bit_get", unsigned(x), i) == 1)


def enumerate_ones(x: Column) -> Column:
    """One row for each place of a one."""
    return F.explode(ones_array(x))


def intervals_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Do the inclusive intervals share a value?"""
    return (a_low <= b_high) & (b_low <= a_high)


def group_label(sym: Column, ignore_bits: int) -> Column:
    """The lowest member of the group that a symbol falls in when its lowest bits are ignored."""
    return F.shiftleft(F.shiftright(sym, ignore_bits), ignore_bits) if ignore_bits else sym


def subcode_separator(sizes: list[int]) -> int:
    """A one at each field's top bit; sizes are listed from the lowest field."""
    if any(s < 1 for s in sizes):
        raise ValueError("each field needs a bit at least")
    out = at = 0
    for s in sizes:
        at += s
        out |= 1 << (at - 1)
    return out


def fields(separator: int, width: int) -> list[tuple[int, int]]:
    """(offset, size) of each field of codes of this many bits, from the lowest; bits above the top mark, if
    there are any, are a field of their own."""
    out, at = [], 0
    for bit in range(width):
        if separator >> bit & 1:
            out.append((at, bit + 1 - at))
            at = bit + 1
    if at < width or not out:
        out.append((at, max(1, width - at)))
    return out


def encode_subcodes(separator: int, values: list[Column | int]) -> Column:
    """Pack field values, from the lowest. A separator of zero is one field."""
    tops = [b for b in range(separator.bit_length()) if separator >> b & 1]
    if len(values) != max(1, len(tops)):
        raise ValueError("one value for each field")
    out, at = F.lit(0).cast("long"), 0
    for k, v in enumerate(values):
        size = tops[k] + 1 - at if tops else 32
        part = _long(v).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, at))
        at += size
    return out


def in_box(sym: Column, lower: int, upper: int, separator: int, width: int, ignore_bits: int = 0) -> Column:
    """Does every field lie within that field's bounds? Ignored low bits count in no field."""
    ok = F.lit(True)
    for at, size in fields(separator, width):
        low, size = max(at, ignore_bits), size - max(0, ignore_bits - at)
        if size <= 0:
            continue
        mask = (1 << size) - 1
        ok = ok & F.shiftright(sym, low).bitwiseAND(F.lit(mask).cast("long")).between(lower >> low & mask, upper >> low & mask)
    return ok
