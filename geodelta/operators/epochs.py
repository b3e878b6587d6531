"""Epochs: observations of one time, at most 14, one a slot, in slot order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.validation import system_error
from ..schema import MAX_SATELLITES, SLOT_MAX, SLOT_MIN
from .chunks import FIELDS, encode_chunks


OBSERVED = ("slot", "seq", "cn0_dbhz", "pseudorange_mm", "doppler_millihz", "carrier_phase_cycles")


def _by_slot(columns: tuple[str, ...], keep: Column | None = None) -> list[Column]:
    """For each slot its first row of a group as an aggregate: at most 14 rows are held, whatever the group, and added up before the shuffle."""
    row = F.struct(*[F.col(c) for c in columns])
    on = lambda s: (F.col("slot") == s) if keep is None else (F.col("slot") == s) & keep
    return [F.min_by(F.when(on(s), row), F.when(on(s), F.col("seq"))).alias(f"_slot_{s + 7}") for s in range(SLOT_MIN, SLOT_MAX + 1)]


def _held() -> Column:
    """The rows of ``_by_slot`` in slot order."""
    return F.array_compact(F.array(*[F.col(f"_slot_{k}") for k in range(MAX_SATELLITES)]))


def group_epochs(obs: DataFrame, rejected: bool = False) -> DataFrame:
    """timestamp_ms, n, min_slot, max_slot, observations (by slot). Times with a slot twice or over 14 rows are dropped, or with
    ``rejected`` only they are given, with their error. One shuffle; at most 14 observations of a time are held."""
    g = obs.groupBy("timestamp_ms").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("slot").alias("min_slot"),
        F.max("slot").alias("max_slot"),
        F.max((F.col("slot").isNull() | ~F.col("slot").between(SLOT_MIN, SLOT_MAX)).cast("int")).alias("bad"),
        *_by_slot(OBSERVED),
    )
    g = g.withColumn("observations", _held()).withColumn("slots", F.size("observations"))
    good = (F.col("n") == F.col("slots")) & (F.col("bad") == 0)
    if rejected:
        code = F.when(F.col("bad") == 1, "InvalidSlot").when(F.col("slots") < F.least("n", F.lit(MAX_SATELLITES)), "DuplicateSlot").otherwise("FrameFull")
        return g.filter(~good).select("timestamp_ms", "n", code.alias("error_code"))
    return g.filter(good).select("timestamp_ms", "n", "min_slot", "max_slot", "observations")


def insert_errors(obs: DataFrame, frame: str = "frame_id", time: str | None = None) -> DataFrame:
    """What happens when rows enter their frame in order of seq: error_code null, InvalidSlot, TimestampMismatch, FrameFull or DuplicateSlot.

    The frame's time is the column ``time``, or that of its first row. A frame is full when it holds all 14 slots, so a row finds it full or its
    slot taken exactly if the slots seen before say so; window counts give what one insert after another would."""
    order = Window.partitionBy(frame).orderBy("seq")
    valid = F.coalesce(F.col("slot").between(SLOT_MIN, SLOT_MAX), F.lit(False))
    out = obs.withColumn("_ts", F.col(time) if time else F.first("timestamp_ms").over(order))
    fits = valid & F.col("timestamp_ms").eqNullSafe(F.col("_ts"))
    out = out.withColumn("_fits", fits)
    out = out.withColumn("_nth", F.row_number().over(Window.partitionBy(frame, "slot", "_fits").orderBy("seq")))
    fresh = F.col("_fits") & (F.col("_nth") == 1)
    out = out.withColumn("_held", F.coalesce(F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    code = (
        F.when(~valid, "InvalidSlot")
        .when(~F.col("_fits"), "TimestampMismatch")
        .when(F.col("_held") >= MAX_SATELLITES, "FrameFull")
        .when(F.col("_nth") > 1, "DuplicateSlot")
    )
    return out.select(*obs.columns, code.alias("error_code"))


def frames(obs: DataFrame, frame: str = "frame_id", partial: bool = False) -> DataFrame:
    """A frame of each group's rows: frame, timestamp_ms, n, min_slot, max_slot, observations (by slot), error_code.

    As when all rows are inserted and the first error refuses the frame: then it has that error and no rows. With ``partial`` the rows that could
    be inserted stay, and the error is the first one."""
    ok = F.col("error_code").isNull()
    g = insert_errors(obs, frame).groupBy(frame).agg(
        F.min_by("timestamp_ms", "seq").alias("timestamp_ms"),
        F.min_by("error_code", F.when(~ok, F.col("seq"))).alias("error_code"),
        *_by_slot(OBSERVED, ok),
    )
    held = _held() if partial else F.when(F.col("error_code").isNull(), _held())
    g = g.withColumn("observations", held)
    slots = F.transform("observations", lambda x: x["slot"])
    return g.select(
        frame, "timestamp_ms", F.coalesce(F.size("observations"), F.lit(0)).alias("n"), F.array_min(slots).alias("min_slot"), F.array_max(slots).alias("max_slot"), "observations", "error_code"
    )


def to_epochs(frames_: DataFrame) -> DataFrame:
    """Frames as epochs: timestamp_ms, n, min_slot, max_slot, observations, error_code. An empty frame is an EmptyChunk error; a refused one keeps its error."""
    n = F.coalesce(F.size("observations"), F.lit(0))
    old = F.col("error_code") if "error_code" in frames_.columns else F.lit(None).cast("string")
    rows = F.array_sort("observations", lambda a, b: a["slot"] - b["slot"])
    slots = F.transform("observations", lambda x: x["slot"])
    return frames_.select(
        "timestamp_ms", n.alias("n"), F.array_min(slots).alias("min_slot"), F.array_max(slots).alias("max_slot"), rows.alias("observations"),
        F.coalesce(old, F.when(n == 0, F.lit("EmptyChunk"))).alias("error_code"),
    )


def to_frames(epochs_: DataFrame) -> DataFrame:
    """Epochs as frames, known by their time: as ``to_epochs``, with frame_id."""
    return to_epochs(epochs_).select(F.col("timestamp_ms").alias("frame_id"), "*")


def contains_slot(observations: Column, slot: int) -> Column:
    return F.exists(observations, lambda x: x["slot"] == slot)


def get_by_slot(observations: Column, slot: int) -> Column:
    return F.get(F.filter(observations, lambda x: x["slot"] == slot), 0)


def epoch_errors(obs: DataFrame) -> DataFrame:
    """Each time's first validation error, in slot order."""
    e = obs.select("timestamp_ms", "slot", "seq", system_error("GLO").alias("e")) if "sat_id" in obs.columns else obs
    return e.filter("e is not null").groupBy("timestamp_ms").agg(F.min_by("e", F.struct("slot", "seq")).alias("e")).select("timestamp_ms", "e.error_code", "e.error_value")


def encode_epochs(obs: DataFrame) -> DataFrame:
    """One chunk an epoch, in slot order; chunk_id is the time."""
    rows = group_epochs(obs).select("timestamp_ms", F.inline("observations"))
    return encode_chunks(rows.withColumn("chunk_id", F.col("timestamp_ms")).drop("seq").withColumn("seq", F.col("slot").cast("long")).select("chunk_id", "seq", *FIELDS))
