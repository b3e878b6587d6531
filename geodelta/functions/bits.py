"""Zigzag, little-endian and bit-string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    z = z.cast("long")
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


_LOW = 0xFFFFFFFF


def wrapping_add(a: Column, b: Column) -> Column:
    """The low 64 bits of a sum, whatever its size; longs stand for unsigned numbers as well."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def wrapping_sub(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(_LOW)) - b.bitwiseAND(F.lit(_LOW))
    high = F.shiftright(a, 32) - F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def delta(current: Column, previous: Column) -> Column:
    """Of signed or unsigned 64-bit numbers; wraps."""
    return wrapping_sub(current, previous)


def delta_of_delta(current: Column, previous: Column, prev_delta: Column) -> Column:
    return wrapping_sub(delta(current, previous), prev_delta)


def reconstruct_from_delta(previous: Column, d: Column) -> Column:
    return wrapping_add(previous, d)


def reconstruct_from_dod(previous: Column, prev_delta: Column, dod: Column) -> Column:
    """The number and its delta, of signed or unsigned 64-bit numbers."""
    d = wrapping_add(prev_delta, dod)
    return F.struct(wrapping_add(previous, d).alias("current"), d.alias("delta"))


def fits(z: Column, bits: int) -> Column:
    """Is the zigzag number under 2**bits? A negative long stands for one of 2**63 or more."""
    return (z >= 0) & (z < (1 << bits))


def bit_string(v: Column, n: int) -> Column:
    """The low n bits of v, first bit first."""
    return F.lpad(F.bin(v.cast("long")), 64, "0").substr(65 - n, n)


def le_hex(v: Column, n: int) -> Column:
    """v as n little-endian bytes, in hex."""
    h = F.lpad(F.hex(v.cast("long")), 16, "0")
    return F.concat(*[h.substr(15 - 2 * k, 2) for k in range(n)])


def header_hex(count: Column) -> Column:
    return F.concat(F.lit("4B524F4701"), le_hex(count, 4))


def verbatim_hex(ts: Column, slot: Column, cn0: Column, pr: Column, dop: Column, phase: Column) -> Column:
    return F.concat(
        le_hex(ts, 8), le_hex(slot, 1), le_hex(cn0, 1), le_hex(pr, 8), le_hex(dop, 4),
        F.when(phase.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), le_hex(phase, 8))),
    )


def pack_hex(bits: Column) -> Column:
    """A bit string padded with zeros to whole bytes, in hex. For bit strings short enough for one row; cross-checks only."""
    # Fixed-width groups by one pass of a pattern: a substring for each byte would walk the whole string each time
    eights = F.regexp_extract_all(F.concat(bits, F.repeat(F.lit("0"), F.pmod(-F.length(bits), F.lit(8)))), F.lit("[01]{8}"), F.lit(0))
    return F.array_join(F.transform(eights, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), "")
