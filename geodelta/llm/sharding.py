"""Sharding by a two-pass external shuffle, DataFrame functions only. Law of the shards: ``rows``.

Method. Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of the row's place in the
input (its partition and row number there), so neither equal texts nor equal or missing ids fall together. Pass 2 reads a reducer's buckets
one by one, applies Fisher-Yates (Spark's seeded ``shuffle``) to the whole records of each, and writes them to the shared folder. The
buckets one after another are a global order; cut into 24 runs whose lengths differ by one at most, it gives shard and slot. Where a bucket starts
is read off the written table.

The number of buckets follows the counted bytes without a limit, so a bucket always fits in memory. Buckets share at most ``REDUCERS`` shuffle partitions,
each sorted by bucket (and spilled if need be), so the number of shuffle blocks stays bounded. The starts are broadcast while they fit, else joined by a merge.
A lost executor repeats its reducers; what is written is not made again, so shard and slot cannot change between uses.

Defined cases: null text is empty; null ids, repeated ids and repeated rows are rows of their own and spread like all others; an
empty table gives an empty result; extra columns of any type travel with the record inside a struct, so their names cannot clash. The same files,
seed and split sizes give the same shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, blank, cut, sum_before

SHARDS = 24
#: Bytes and rows of a bucket that a task can hold as records.
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 200_000
#: Shuffle partitions at most; beyond, each holds several buckets.
REDUCERS = 16_384


def two_pass_shuffle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 17
) -> DataFrame:
    """Every record as struct ``record``, with shard int and slot long (gapless from 0)."""
    # bytes of the text, and an allowance for the other columns
    sized = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(blank(text)) + F.lit(64)).alias("b")).first()
    total, size = int(sized["n"]), int(sized["b"] or 0)
    buckets = max(1, -(-size // BUCKET_BYTES), -(-total // BUCKET_ROWS))
    reducers = min(buckets, REDUCERS)
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    placed = docs.select(record.alias("record"), F.monotonically_increasing_id().alias("place"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("place")), F.lit(buckets)).cast("int")
    placed = placed.withColumn("bucket", bucket).withColumn("reducer", F.pmod("bucket", F.lit(reducers)).cast("int"))
    scattered = placed.repartitionById(reducers, F.col("reducer"))
    # pass 2: records cannot be compared if they hold maps, so a bucket is put in order by place alone
    held = scattered.groupBy("reducer", "bucket").agg(F.collect_list(F.struct("place", "record")).alias("held"))
    by_place = lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1)
    shuffled = held.select("bucket", F.array_sort("held", by_place).alias("held")).select("bucket", F.expr(f"shuffle(held, {seed}L)").alias("held"))
    written = cut(shuffled.select("bucket", F.posexplode("held").alias("at", "e")).select("bucket", "at", "e.record"), "buckets")
    counts = cut(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    starts = cut(sum_before(counts, [], "bucket", "n").select("bucket", F.col("before").alias("start")), "starts")
    starts = F.broadcast(starts) if buckets * 16 <= BROADCAST_BYTES else starts.hint("merge")
    base, more = divmod(total, shards)
    edge = more * (base + 1)
    pos = F.col("start") + F.col("at")
    first = pos < edge
    return (
        written.join(starts, "bucket")
        .withColumn("pos", pos)
        .select(
            "record",
            F.when(first, F.expr(f"pos div {base + 1}"))
            .otherwise(F.expr(f"{more} + (pos - {edge}) div {max(base, 1)}"))
            .cast("int")
            .alias("shard"),
            F.when(first, F.expr(f"pos % {base + 1}")).otherwise(F.expr(f"(pos - {edge}) % {max(base, 1)}")).alias("slot"),
        )
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write the shuffled records as Parquet, a folder a shard, in slot order within each file."""
    out = two_pass_shuffle(docs, key, text, shards)
    out.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns for each document."""
    text = blank(F.col("record.text"))
    return two_pass_shuffle(docs, shards=shards).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
