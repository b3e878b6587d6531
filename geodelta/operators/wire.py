"""Format versions and compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VERSION

DESCRIPTIONS = {VERSION: "Version 1 (initial encoding)"}


def format_version(v: Column) -> Column:
    """A byte as a version: version and description, or the error InvalidVersion with the byte."""
    known = F.coalesce(v.isin(*DESCRIPTIONS), F.lit(False))
    shown = F.lit(None).cast("string")
    for version, text in DESCRIPTIONS.items():
        shown = F.when(v == version, F.lit(text)).otherwise(shown)
    return F.struct(
        F.when(known, v.cast("int")).alias("version"),
        shown.alias("description"),
        F.when(~known, F.lit("InvalidVersion")).alias("error_code"),
        F.when(~known, v.cast("long")).alias("error_value"),
    )


def can_read(reader: Column, written: Column) -> Column:
    return reader >= written


def can_write(writer: Column, wanted: Column) -> Column:
    return writer >= wanted


def is_deprecated(v: Column) -> Column:
    return F.lit(False)


def compatibility(reader: Column, written: Column) -> Column:
    """readable, writable, deprecated and up to three warnings."""
    warnings = F.array(
        F.when(is_deprecated(written), F.lit("format is deprecated")),
        F.when(written > reader, F.lit("format is newer than the reader")),
        F.when(~can_read(reader, written), F.lit("format cannot be read")),
    )
    return F.struct(
        can_read(reader, written).alias("readable"),
        can_write(reader, written).alias("writable"),
        is_deprecated(written).alias("deprecated"),
        F.array_compact(warnings).alias("warnings"),
    )
