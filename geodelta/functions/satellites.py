"""Satellite ids, units and derived values as columns. ``c`` is the constellation, ``s`` the satellite id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GLONASS_BASE_HZ, GLONASS_STEP_HZ, PHASE_BYTES, RAW_ROW, SLOT_MAX, SLOT_MIN, SYSTEMS


def carrier_freq_hz(slot: Column) -> Column:
    """Carrier of a GLONASS slot; null outside the slots."""
    return F.when(slot.between(SLOT_MIN, SLOT_MAX), F.lit(GLONASS_BASE_HZ) + slot.cast("long") * GLONASS_STEP_HZ)


def pseudorange_m(mm: Column) -> Column:
    return mm / F.lit(1000.0)


def doppler_hz(mhz: Column) -> Column:
    return mhz / F.lit(1000.0)


def doppler_abs(mhz: Column) -> Column:
    return F.abs(mhz.cast("long"))


def satellite(c: Column, s: Column) -> Column:
    return F.struct(c.alias("constellation"), s.alias("sat_id"))


def glonass(slot: Column) -> Column:
    """A GLONASS satellite; null outside the slots. The others likewise by their numbers."""
    return _of("GLO", slot)


def gps(prn: Column) -> Column:
    return _of("GPS", prn)


def galileo(svn: Column) -> Column:
    return _of("GAL", svn)


def beidou(prn: Column) -> Column:
    return _of("BDS", prn)


def _of(name: str, s: Column) -> Column:
    return F.when(id_in_range(F.lit(name), s), satellite(F.lit(name), s.cast("int")))


def is_fdma(c: Column) -> Column:
    return c == "GLO"


def order_of(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in SYSTEMS]), c).cast("int") - 1


def to_wire(c: Column, s: Column) -> Column:
    """The id as it is written: GLONASS slots from 0."""
    return F.when(is_fdma(c), s + 7).otherwise(s).cast("int")


def from_wire(c: Column, code: Column) -> Column:
    """The id of a written code; null where it is out of range."""
    s = F.when(is_fdma(c), code.cast("int") - 7).otherwise(code.cast("int"))
    return F.when(id_in_range(c, s), s)


def id_in_range(c: Column, s: Column) -> Column:
    ok = F.lit(False)
    for name, (low, high, *_) in SYSTEMS.items():
        ok = ok | ((c == name) & s.between(low, high))
    return ok


def display_id(c: Column, s: Column) -> Column:
    return F.concat(c, F.lpad(to_wire(c, s).cast("string"), 2, "0"))


def glonass_slot(c: Column, s: Column) -> Column:
    return F.when(is_fdma(c), s)


def slot_to_index(slot: Column) -> Column:
    return slot.cast("int") + 7


def index_to_slot(index: Column) -> Column:
    return F.when(index.between(0, 13), index.cast("int") - 7)


def registry_index(c: Column, s: Column) -> Column:
    """Place of a satellite among its system's codec states."""
    return F.when(is_fdma(c), s + 7).otherwise(s - 1).cast("int")


def raw_size(phase: Column) -> Column:
    return (F.lit(RAW_ROW) + F.when(phase.isNotNull(), PHASE_BYTES).otherwise(0)).cast("long")


def zeroed() -> Column:
    """The all-zero placeholder observation; it fails validation."""
    zero = F.lit(0)
    return F.struct(
        zero.cast("long").alias("timestamp_ms"), zero.alias("sat_id"), zero.alias("cn0_dbhz"),
        zero.cast("long").alias("pseudorange_mm"), zero.alias("doppler_millihz"), F.lit(None).cast("long").alias("carrier_phase_cycles"),
    )
