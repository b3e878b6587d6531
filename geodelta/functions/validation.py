"""Validation as columns: a struct (error_code, error_value, error_message), null where a row is valid; the first error wins.

The data model has no nulls: a null is an error of its field, without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CN0_MAX, CN0_STRONG, CN0_TRACKED, GENERIC_MAX_DOPPLER, SYSTEMS


def _error(code: str, value: Column) -> Column:
    value = value.cast("long")
    return F.struct(
        F.lit(code).alias("error_code"), value.alias("error_value"), F.concat(F.lit(f"{code}("), F.coalesce(value.cast("string"), F.lit("null")), F.lit(")")).alias("error_message")
    )


def id_error(system: str, s: Column) -> Column:
    low, high, *_, code = SYSTEMS[system]
    return F.when(s.isNull() | ~s.between(low, high), _error(code, s))


def pseudorange_error(system: str, mm: Column) -> Column:
    _, _, low, high, *_ = SYSTEMS[system]
    return F.when(mm.isNull() | ~mm.between(low, high), _error("InvalidPseudorange", mm))


def doppler_error(system: str, mhz: Column) -> Column:
    size = F.abs(mhz.cast("long"))
    return F.when(size.isNull() | (size > SYSTEMS[system][4]), _error("InvalidDoppler", size))


def system_error(system: str) -> Column:
    return F.coalesce(
        id_error(system, F.col("sat_id")), pseudorange_error(system, F.col("pseudorange_mm")), doppler_error(system, F.col("doppler_millihz"))
    )


def is_valid_id(system: str, s: Column) -> Column:
    return id_error(system, s).isNull()


def is_valid_pseudorange(system: str, mm: Column) -> Column:
    return pseudorange_error(system, mm).isNull()


def is_valid_doppler(system: str, mhz: Column) -> Column:
    return doppler_error(system, mhz).isNull()


def is_valid(system: str) -> Column:
    """Is the row valid as one of the system?"""
    return system_error(system).isNull()


def observation_error() -> Column:
    """Validation by the row's own system."""
    out = F.lit(None)
    for system in SYSTEMS:
        out = F.when(F.col("constellation") == system, system_error(system)).otherwise(out)
    return out


def generic_error() -> Column:
    mm, mhz = F.col("pseudorange_mm"), F.col("doppler_millihz").cast("long")
    return F.coalesce(
        F.when(mm.isNull() | (mm <= 0), _error("InvalidPseudorange", mm)), F.when(mhz.isNull() | (F.abs(mhz) > GENERIC_MAX_DOPPLER), _error("InvalidDoppler", mhz))
    )


def cn0_error(cn0: Column) -> Column:
    return F.when(cn0.isNull() | ~cn0.between(0, CN0_MAX), _error("InvalidDbHz", cn0))


def timestamp_error(ms: Column) -> Column:
    """An extension: Spark has no unsigned 64-bit type, so negative times are refused."""
    return F.when(ms < 0, _error("InvalidTimestamp", ms))


def is_tracked(cn0: Column) -> Column:
    return cn0 >= CN0_TRACKED


def is_strong(cn0: Column) -> Column:
    return cn0 >= CN0_STRONG


def validate(df: DataFrame, error: Column, mode: str = "PERMISSIVE") -> DataFrame:
    """PERMISSIVE adds the error's columns, DROPMALFORMED drops bad rows, FAILFAST raises on a bad row (of several tasks, the first to meet one)."""
    out = df.withColumn("_error", error)
    if mode == "DROPMALFORMED":
        return out.filter(F.col("_error").isNull()).drop("_error")
    if mode == "FAILFAST":
        checked = F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error.error_message")).cast("boolean")).otherwise(True)
        return out.filter(checked).drop("_error")
    return out.select(*df.columns, "_error.error_code", "_error.error_value", "_error.error_message")
