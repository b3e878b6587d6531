"""Predictors and buckets of the chunk codec as window columns: sizes and bit strings without a packer.

All windows share the chunk's partitioning, so a plan has one shuffle by chunk; per-slot Doppler history adds a sort. Columns ``r_*`` are
residuals and ``b_*`` the buckets' sizes in bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.bits import bit_string, fits, wrapping_sub, zigzag
from ..functions.satellites import raw_size
from ..schema import HEADER_LEN

FIELDS = ("ts", "slot", "cn0", "pr", "doppler", "phase")


def phase_kinds(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """(chunk, seq, kind, z): kinds -1 first row, 0 none, 1 lost, 2 found, 3 same, 4 near, 5 absolute; z is the residual in zigzag."""
    ph = F.col("carrier_phase_cycles")
    kind = (
        F.when(F.col("n") == 1, -1)
        .when(ph.isNull(), F.when(F.col("p_phase").isNull(), 0).otherwise(1))
        .when(F.col("b_phase") == 66, 2)
        .when(F.col("b_phase") == 3, 3)
        .when(F.col("b_phase") == 36, 4)
        .otherwise(5)
    )
    return predicted(obs, chunk).select(chunk, "seq", kind.alias("kind"), zigzag(F.col("r_phase")).alias("z"))


def _phase(obs: DataFrame, w: WindowSpec) -> DataFrame:
    """Adds p_phase, d_phase and r_phase. Whether a row's delta is remembered depends on whether the last one's was: a recurrence of booleans.

    Most rows decide it alone (both answers agree); of the others some turn it round. So it is the answer of the last row that decides alone, turned
    as many times as there were turning rows since: window sums over the chunk, no fold."""
    ph = F.col("carrier_phase_cycles")
    out = obs.withColumn("p_phase", F.lag(ph).over(w)).withColumn("d_phase", wrapping_sub(ph, F.col("p_phase")))
    out = out.withColumn("_after", wrapping_sub(F.col("d_phase"), F.lag("d_phase").over(w)))
    near = lambda c: F.coalesce(fits(zigzag(F.col(c)), 32), F.lit(False))
    alone, then = near("d_phase"), F.when(F.col("_after").isNull(), near("d_phase")).otherwise(near("_after"))
    decided = (F.col("n") == 1) | (alone == then)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_turns", F.sum((~decided & alone).cast("int")).over(so_far))
    state = F.last(F.when(decided, F.struct((alone & (F.col("n") > 1)).alias("kept"), F.col("_turns").alias("turns"))), ignorenulls=True).over(so_far)
    out = out.withColumn("_state", state)
    kept = (F.col("_state.kept").cast("int") + F.col("_turns") - F.col("_state.turns")) % 2 == 1
    out = out.withColumn("_kept", F.lag(kept, 1, False).over(w))
    return out.withColumn("r_phase", F.when(F.col("_kept"), F.col("_after")).otherwise(F.col("d_phase"))).drop("_after", "_turns", "_state", "_kept")


def predicted(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Residuals and bucket sizes of each row, those of the packer for any values; differences wrap at 64 bits."""
    w = Window.partitionBy(chunk).orderBy("seq")
    per_slot = Window.partitionBy(chunk, "slot").orderBy("seq")
    ts, pr, ph = F.col("timestamp_ms"), F.col("pseudorange_mm"), F.col("carrier_phase_cycles")
    out = obs.withColumn("n", F.row_number().over(w))
    first = F.col("n") == 1
    for name, c in (("ts", ts), ("pr", pr)):
        out = out.withColumn(f"d_{name}", wrapping_sub(c, F.lag(c).over(w)))
        out = out.withColumn(f"r_{name}", wrapping_sub(F.col(f"d_{name}"), F.coalesce(F.lag(f"d_{name}").over(w), F.lit(0).cast("long"))))
    out = (
        out.withColumn("r_slot", F.col("slot") != F.lag("slot").over(w))
        .withColumn("r_cn0", F.col("cn0_dbhz") - F.lag("cn0_dbhz").over(w))
        .withColumn("r_doppler", F.col("doppler_millihz").cast("long") - F.lag(F.col("doppler_millihz").cast("long")).over(per_slot))
    )
    out = _phase(out, w)
    z = {k: zigzag(F.col(f"r_{k}")) for k in ("ts", "cn0", "pr", "doppler", "phase")}
    dod = lambda k, near, far: F.when(F.col(f"r_{k}") == 0, 1).when(fits(z[k], near[0]), near[1]).when(fits(z[k], far[0]), far[1]).otherwise(67)
    sizes = {
        "ts": dod("ts", (7, 9), (9, 12)),
        "slot": F.when(F.col("r_slot"), 5).otherwise(1),
        "cn0": F.when(F.col("r_cn0") == 0, 1).otherwise(10),
        "pr": dod("pr", (10, 12), (20, 23)),
        "doppler": F.when(F.col("r_doppler").isNull(), 33).when(F.col("r_doppler") == 0, 2).when(fits(z["doppler"], 14), 17).otherwise(35),
        "phase": F.when(ph.isNull(), 2).when(F.col("p_phase").isNull(), 66).when(F.col("r_phase") == 0, 3).when(fits(z["phase"], 32), 36).otherwise(68),
    }
    for k, size in sizes.items():
        out = out.withColumn(f"b_{k}", F.when(first, 0).otherwise(size).cast("int"))
    return out.withColumn("bits", sum((F.col(f"b_{k}") for k in FIELDS[1:]), F.col("b_ts")).cast("long"))


def bit_strings(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """The rows of ``predicted`` with the bits that each row adds to the stream; empty for a chunk's first row."""
    out = predicted(obs, chunk)
    s = lambda c, n: bit_string(F.col(c) if isinstance(c, str) else c, n)
    zz = lambda k, n: s(zigzag(F.col(f"r_{k}")), n)
    tag = lambda t, b: F.concat(F.lit(t), b)

    def choose(k: str, cases: dict[int, Column]) -> Column:
        col = F.lit("")
        for size, bits in cases.items():
            col = F.when(F.col(f"b_{k}") == size, bits).otherwise(col)
        return col

    parts = [
        choose("ts", {1: F.lit("0"), 9: tag("10", zz("ts", 7)), 12: tag("110", zz("ts", 9)), 67: tag("111", s("timestamp_ms", 64))}),
        choose("slot", {1: F.lit("0"), 5: tag("1", s(F.col("slot") + 7, 4))}),
        choose("cn0", {1: F.lit("0"), 10: tag("1", zz("cn0", 9))}),
        choose("pr", {1: F.lit("0"), 12: tag("10", zz("pr", 10)), 23: tag("110", zz("pr", 20)), 67: tag("111", s("pseudorange_mm", 64))}),
        choose("doppler", {33: tag("0", s("doppler_millihz", 32)), 2: F.lit("10"), 17: tag("110", zz("doppler", 14)), 35: tag("111", s("doppler_millihz", 32))}),
        choose("phase", {
            2: F.when(F.col("p_phase").isNull(), F.lit("00")).otherwise(F.lit("01")),
            66: tag("10", s("carrier_phase_cycles", 64)), 3: F.lit("110"), 36: tag("1110", zz("phase", 32)), 68: tag("1111", s("carrier_phase_cycles", 64)),
        }),
    ]
    return out.withColumn("stream", F.concat(*parts))


def summary(sizes: DataFrame) -> DataFrame:
    """Over all chunks of ``chunk_sizes``: their number, rows, bytes, average, least and largest ratio, and bytes a row before and after."""
    total = sizes.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("chunk_bytes").alias("chunk_bytes"),
        F.avg("ratio").alias("avg_ratio"),
        F.min("ratio").alias("least"),
        F.max("ratio").alias("most"),
    )
    return total.withColumns({"raw_per_row": F.col("raw_bytes") / F.col("n_rows"), "bytes_per_row": F.col("chunk_bytes") / F.col("n_rows")})


def chunk_sizes(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Per chunk: rows, raw bytes, encoded bytes, ratio and bits a row, by sums alone; the bytes are those the packer writes."""
    p = predicted(obs, chunk).withColumn("raw", raw_size(F.col("carrier_phase_cycles")))
    g = p.groupBy(chunk).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("raw").alias("raw_bytes"),
        F.sum("bits").alias("stream_bits"),
        F.sum(F.when(F.col("n") == 1, F.col("raw"))).alias("first_bytes"),
    )
    size = F.lit(HEADER_LEN) + F.col("first_bytes") + F.floor((F.col("stream_bits") + 7) / 8)
    return g.select(chunk, "n_rows", "raw_bytes", "stream_bits", size.cast("long").alias("chunk_bytes")).withColumns(
        {"ratio": F.col("raw_bytes") / F.col("chunk_bytes"), "bits_per_row": F.col("chunk_bytes") * 8.0 / F.col("n_rows")}
    )
