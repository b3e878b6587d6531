"""Doppler codecs on plain numbers, one value at a time: a codec writes and reads a value for an id and keeps a state for each id.

``operators.doppler`` does the same for whole columns; tests hold one against the other.
"""

from __future__ import annotations

from typing import Protocol

from .codec import BitReader, BitWriter, zz
from .schema import EMA_SHIFT, SYSTEMS, CodecError


def wrap32(v: int) -> int:
    """The low 32 bits as a signed number."""
    v &= 0xFFFFFFFF
    return v - (1 << 32) if v >> 31 else v


class DopplerCodec(Protocol):
    """Both directions of a codec; ``reset`` at the start of a chunk."""

    def reset(self) -> None: ...
    def encode(self, writer: BitWriter, value: int, of) -> None: ...
    def decode(self, reader: BitReader, of) -> int: ...


class Cdma:
    """Differences to the satellite's last value."""

    SMALL = 16

    def __init__(self) -> None:
        self.known: dict = {}

    def reset(self) -> None:
        self.known = {}

    def after(self, base: int, value: int) -> int:
        """What the next value of the id is compared with."""
        return value

    def residual(self, base: int, value: int) -> int:
        return value - base

    def first_flag(self, flag: int) -> None:
        if flag:
            raise CodecError("InvalidBitPattern")

    def encode(self, writer: BitWriter, value: int, of) -> None:
        raw, base = value & 0xFFFFFFFF, self.known.get(of)
        if base is None:
            writer.write(raw, 33)
            self.known[of] = value
            return
        residual = self.residual(base, value)
        if residual == 0:
            writer.write(0b10, 2)
        elif zz(residual) < 1 << self.SMALL:
            writer.write(0b110, 3)
            writer.write_signed(residual, self.SMALL)
        else:
            writer.write(0b111, 3)
            writer.write(raw, 32)
            self.known[of] = value
            return
        self.known[of] = self.after(base, value)

    def decode(self, reader: BitReader, of) -> int:
        base = self.known.get(of)
        flag = reader.read(1)
        if base is None:
            self.first_flag(flag)
            value = self.known[of] = wrap32(reader.read(32))
            return value
        second = reader.read(1)
        if not flag:
            raise CodecError("UnexpectedEof")
        if second and reader.read(1):
            value = self.known[of] = wrap32(reader.read(32))
            return value
        value = wrap32(base + reader.read_signed(self.SMALL)) if second else base
        self.known[of] = self.after(base, value)
        return value


class Fdma(Cdma):
    """Differences to a slow average of the slot's values."""

    SMALL = 14

    def after(self, base: int, value: int) -> int:
        return wrap32(base + ((value - base) >> EMA_SHIFT))

    def residual(self, base: int, value: int) -> int:
        return wrap32(value - base)

    def first_flag(self, flag: int) -> None:
        """Not looked at."""


class Registry:
    """The codec of each system; ids are (system, satellite)."""

    def __init__(self) -> None:
        self.codecs: dict[str, Cdma] = {s: Fdma() if s == "GLO" else Cdma() for s in SYSTEMS}

    def reset(self) -> None:
        for c in self.codecs.values():
            c.reset()

    def encode(self, writer: BitWriter, value: int, of: tuple[str, int]) -> None:
        self.codecs[of[0]].encode(writer, value, of[1])

    def decode(self, reader: BitReader, of: tuple[str, int]) -> int:
        return self.codecs[of[0]].decode(reader, of[1])
