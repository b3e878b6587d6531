"""Observations made from the event table, by whole-number rules that SQL expresses as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_ROWS = 512


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, chunk_id, slot, constellation, sat_id, timestamp_ms, cn0_raw, cn0_dbhz, pseudorange_mm, doppler_millihz, carrier_phase_cycles."""
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def from_events(events: DataFrame) -> DataFrame:
    # Bases and steps of the made-up observations
    e = events.select("event_id", "ts", "user_id", "value")
    seq, user = F.col("event_id"), F.col("user_id")
    slot = (user % 14 - 7).cast("int")
    system = F.element_at(F.array(*[F.lit(s) for s in ("GLO", "GPS", "GAL", "BDS")]), (user % 4 + 1).cast("int"))
    return e.select(
        seq.alias("seq"),
        F.floor(seq / CHUNK_ROWS).cast("long").alias("chunk_id"),
        user.alias("track_id"),
        slot.alias("slot"),
        system.alias("constellation"),
        F.when(user % 4 == 0, slot).otherwise(user % 32 + 1).cast("int").alias("sat_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        (seq % 80).cast("int").alias("cn0_raw"),
        (seq % 61).cast("int").alias("cn0_dbhz"),
        (F.lit(21_500_000_000) + F.floor(F.col("value") * 1000)).cast("long").alias("pseudorange_mm"),
        (seq * 7919 % 10_000_001 - 5_000_000).cast("int").alias("doppler_millihz"),
        F.when(seq % 5 != 0, F.lit(100_000) + seq * 65536).cast("long").alias("carrier_phase_cycles"),
    )


#: The same table for DuckDB.
SQL = """
obs AS (SELECT event_id AS seq, event_id // 512 AS chunk_id, user_id AS track_id, CAST(user_id % 14 - 7 AS INTEGER) AS slot,
 CASE user_id % 4 WHEN 0 THEN 'GLO' WHEN 1 THEN 'GPS' WHEN 2 THEN 'GAL' ELSE 'BDS' END AS constellation,
 CAST(CASE WHEN user_id % 4 = 0 THEN user_id % 14 - 7 ELSE user_id % 32 + 1 END AS INTEGER) AS sat_id,
 epoch_us(ts) // 1000 AS timestamp_ms, CAST(event_id % 80 AS INTEGER) AS cn0_raw, CAST(event_id % 61 AS INTEGER) AS cn0_dbhz,
 21500000000 + CAST(floor(value * 1000) AS BIGINT) AS pseudorange_mm,
 CAST((event_id * 7919) % 10000001 - 5000000 AS INTEGER) AS doppler_millihz,
 CASE WHEN event_id % 5 <> 0 THEN 100000 + event_id * 65536 END AS carrier_phase_cycles FROM events)
"""
