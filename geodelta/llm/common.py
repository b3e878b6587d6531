"""Shared helpers: scratch tables in the shared folder, size-checked joins, heavy-key joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast only when its rows were counted and fit in this many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row group of scratch tables, which a task holds while it writes.
ROW_GROUP = 32 << 20
#: A key is heavy when it holds more than 1/HEAVY of all rows; at most HEAVY keys can be.
HEAVY = 4096
#: A key of up to so many rows is never heavy.
LIGHT_ROWS = 1000


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="geodelta-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, one of our own in local mode (tests); on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir(spark.conf.get("spark.app.id", ""))
    return base.rstrip("/")


def write_scratch(df: DataFrame, tag: str) -> str:
    """Write df once as a Parquet table in the shared folder; give its path."""
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return path


def remove(df: DataFrame) -> None:
    """Delete the written tables that df reads; only for scratch tables that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. Survives lost executors."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_scratch(df, tag))


def small_or_shuffled(big: DataFrame, small: DataFrame, key: str, how: str, row_bytes: int) -> DataFrame:
    """Join big with a written side on key: broadcast when its counted rows fit, else a shuffle join.

    Both ways give the same rows. ``small`` is a written table with unique keys, so counting is cheap.
    """
    n = small.count()
    if n * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    else:
        small = small.hint("merge")
    return big.join(small, key, how)


#: Hash buckets of ``split_by_keys``: the broadcast of all of them takes about 32 MB, whatever the keys' number.
KEY_BUCKETS = 1 << 21


def split_by_keys(big: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split big into rows whose key may be among keys, and rows whose key surely is not, without a shuffle of big.

    The hash buckets of the keys are broadcast; there are at most KEY_BUCKETS. With very many keys, all rows may go to the
    first part; results do not depend on it.
    """
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(KEY_BUCKETS)).cast("int")
    marked = F.broadcast(keys.select(bucket.alias("bucket")).distinct())
    # the bucket is compared as an expression, so no column of big can clash with it
    same = bucket_of(big, key) == marked["bucket"]
    return big.join(marked, same, "left_semi"), big.join(marked, same, "left_anti")


def bucket_of(df: DataFrame, key: str) -> Column:
    return F.pmod(F.xxhash64(df[key]), F.lit(KEY_BUCKETS)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def heavy_join(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """Inner or left join of rows with one written row per key, where a key may hold a large part of all rows.

    Keys with more than total/HEAVY rows (at most HEAVY of them, so their broadcast is bounded) are
    joined map-side; the rest shuffle, each with at most total/HEAVY rows to a key.
    """
    bound = max(LIGHT_ROWS, total // HEAVY)
    heavy = groups.filter(F.col(count) > bound)
    light = groups.filter(F.col(count) <= bound)
    if heavy.limit(1).count() == 0:
        return rows.join(light, keys, how)
    hot = F.broadcast(heavy)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(light, keys, how))


def salted_join(rows: DataFrame, single: DataFrame, key: str, salt_by: str, counted: DataFrame, total: int) -> DataFrame:
    """Inner join of rows with a wide row per key, where a key may hold a large part of all rows; ``counted``: a written table with the same keys.

    A key of more than total/HEAVY rows is dealt over parts of about that size, and its wide row goes to each of them; there are
    at most HEAVY such keys, and at most 2 HEAVY parts of them, so what is broadcast and repeated is bounded.
    """
    bound = max(LIGHT_ROWS, total // HEAVY)
    hot = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound)
    hot = cut(hot.select(key, F.ceil(F.col("n") / bound).cast("int").alias("parts")), "hot")
    if hot.limit(1).count() == 0:
        return rows.join(single, key)
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(salt_by), parts).cast("int")).drop("parts")
    each = single.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(each, [key, "salt"]).drop("salt")


def sum_before(counts: DataFrame, group: list[str], at: str, value: str, part: int = 1000) -> DataFrame:
    """Written counts with ``before``: the sum of value over the group's rows with a smaller ``at`` (whole numbers, each once).

    In two steps, within parts of ``part`` numbers and over the parts, so a task holds a part, or one row for each part of a group."""

    def running(column: str, order: str, *by: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(w), F.lit(0))

    parted = counts.withColumn("_part", F.expr(f"{at} div {part}"))
    parts = parted.groupBy(*group, "_part").agg(F.sum(value).alias("_held"))
    parts = parts.withColumn("_parts_before", running("_held", "_part", *group)).drop("_held")
    inside = parted.withColumn("_inside", running(value, at, *group, "_part"))
    whole = inside.join(parts, [*group, "_part"]).withColumn("before", F.col("_inside") + F.col("_parts_before"))
    return whole.drop("_part", "_inside", "_parts_before")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // most
        edges = np.flatnonzero(np.diff(block)) + 1
        at = 0
        for end in [*edges.tolist(), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
                at = end
    give_back_memory()


def give_back_memory() -> None:
    """A Python worker is kept for later tasks; what this task has freed goes back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blank(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bound_batches(spark: SparkSession) -> None:
    """Batches hold little, however long the texts are: to and from Python about 2 MB, from Parquet some hundred rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
