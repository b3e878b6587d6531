"""Chunk encode and decode: rows to BINARY and back, in Arrow batches."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codec, vector
from ..schema import CHUNKS, NULL_VALUE, CodecError

FIELDS = ("timestamp_ms", "slot", "cn0_dbhz", "pseudorange_mm", "doppler_millihz", "carrier_phase_cycles")
DECODED = (
    "chunk_id long, seq long, timestamp_ms long, slot int, cn0_dbhz int, pseudorange_mm long, doppler_millihz int, "
    "carrier_phase_cycles long, error_code string"
)


#: Rows that are encoded at a time, about, and bytes of payloads that are decoded at a time.
BATCH_ROWS, DECODE_BYTES = 1 << 16, 1 << 21


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = BATCH_ROWS) -> Iterator[pa.Table]:
    """Tables of about so many rows from batches sorted by key; a key's rows are never split. Null is a key of its own."""
    held: list[pa.RecordBatch] = []
    count, need = 0, rows
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= need:
            table = pa.Table.from_batches(held)
            edge = group_starts(table[key])[-1] if count else 0
            if edge:
                yield table.slice(0, edge)
            rest = table.slice(edge)
            held, count = rest.to_batches(), rest.num_rows
            need = max(rows, 2 * count)  # a long group is looked at again when it has doubled
    if count:
        yield pa.Table.from_batches(held)


def group_starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal keys start."""
    none = keys.is_null().to_numpy()
    values = keys.fill_null(0).to_numpy()
    changed = (values[1:] != values[:-1]) | (none[1:] != none[:-1])
    return np.concatenate([[0], np.flatnonzero(changed) + 1]) if len(values) else np.zeros(0, np.int64)


def in_order(obs: DataFrame, *keys: str) -> DataFrame:
    """One shuffle by the first key; rows sorted by all keys in their partition."""
    return obs.repartition(F.col(keys[0])).sortWithinPartitions(*keys)


def _rows(table: pa.Table) -> vector.Rows:
    ints = [table[f].cast(pa.int64()).fill_null(0).to_numpy() for f in FIELDS]
    return vector.Rows(*ints, ~table[FIELDS[-1]].is_null().to_numpy())


def encode_chunks(obs: DataFrame, chunk: str = "chunk_id", mode: str = "PERMISSIVE") -> DataFrame:
    """One row a chunk: chunk_id, sample_count, payload, error_code. Rows are taken in the order of ``seq``.

    FAILFAST raises on the first bad chunk; PERMISSIVE gives it an error and no payload. A null in a field other than the phase is a NullValue
    error. Many chunks are encoded at once in a partition; a chunk lies in one task, so chunks should hold some thousand rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "chunk_id"):
            starts = np.append(group_starts(table["chunk_id"]), table.num_rows)
            payloads, found = vector.encode(_rows(table), starts)
            errors = [None if e is None else str(e) for e in found]
            none = np.zeros(table.num_rows, bool)
            for f in FIELDS[:-1]:
                none |= table[f].is_null().to_numpy()
            for k in np.unique(np.searchsorted(starts, np.flatnonzero(none), "right") - 1).tolist():
                payloads[k], errors[k] = None, NULL_VALUE
            if mode == "FAILFAST" and any(errors):
                raise CodecError(next(e for e in errors if e))
            ids = table["chunk_id"].combine_chunks().take(pa.array(starts[:-1]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(starts)), pa.array(payloads, pa.binary()), pa.array(errors, pa.string())],
                ["chunk_id", "sample_count", "payload", "error_code"],
            )

    rows = obs.select(F.col(chunk).cast("long").alias("chunk_id"), "seq", *FIELDS)
    return in_order(rows, "chunk_id", "seq").drop("seq").mapInArrow(run, CHUNKS)


def decode_chunks(chunks: DataFrame, mode: str = "PERMISSIVE", max_samples: int | None = None) -> DataFrame:
    """Rows of all chunks, without a shuffle. PERMISSIVE gives the good rows and then one row with the error; FAILFAST raises;
    DROPMALFORMED leaves out the chunks that have an error. ``max_samples``: a chunk of more rows is a BufferFull error."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in DECODED.split(", ")]

    def too_long(payload: bytes) -> CodecError | None:
        try:
            return CodecError("BufferFull") if max_samples is not None and codec.read_header(payload) > max_samples else None
        except CodecError:
            return None  # found again, in its order

    def amiss(chunk: int, payload: bytes, early: CodecError | None) -> list[tuple]:
        """The rows of a chunk that is not decoded with the others: an error, or no rows at all."""
        rows, error = ([], early) if early else vector.whole(payload)
        if error is None:
            return []
        if mode == "FAILFAST":
            raise error
        good = [(chunk, k, codec.signed(r[0]), *r[1:], None) for k, r in enumerate(rows)]
        return [] if mode == "DROPMALFORMED" else [*good, (chunk, len(good), *[None] * 6, str(error))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "payload", DECODE_BYTES):
            ids, payloads = batch.column("chunk_id"), batch.column("payload").to_pylist()
            early = [too_long(p) for p in payloads]
            rows, of, number = vector.decode([b"" if e else p for p, e in zip(payloads, early)])
            if len(of):
                columns = [ids.take(pa.array(of)), pa.array(number), *[pa.array(getattr(rows, f)) for f in ("ts", "slot", "cn0", "pr", "doppler")]]
                phase = pa.array(rows.phase, mask=~rows.held)
                yield pa.RecordBatch.from_arrays([*[c.cast(k) for c, k in zip([*columns, phase], kinds)], pa.nulls(len(of), pa.string())], names)
            done = set(of.tolist())
            left = [r for k, p in enumerate(payloads) if k not in done for r in amiss(ids[k].as_py(), p, early[k])]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*left), kinds)], names)

    return chunks.select("chunk_id", "payload").filter("payload is not null").mapInArrow(run, DECODED)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of a column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64) // most
        at = 0
        for end in [*(np.flatnonzero(np.diff(total)) + 1).tolist(), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
                at = end


def gzip_sizes(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """chunk_id, raw_bytes and gzip_bytes of each chunk's plain rows, for comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "chunk_id"):
            starts = np.append(group_starts(table["chunk_id"]), table.num_rows).tolist()
            rows = _rows(table)
            plain = [b"".join(codec.verbatim(rows.row(i)) for i in range(a, b)) for a, b in zip(starts, starts[1:])]
            ids = table["chunk_id"].combine_chunks().take(pa.array(starts[:-1]))
            packed = [len(gzip.compress(p, 6)) for p in plain]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(p) for p in plain], pa.int64()), pa.array(packed, pa.int64())], ["chunk_id", "raw_bytes", "gzip_bytes"])

    rows = obs.select(F.col(chunk).cast("long").alias("chunk_id"), "seq", *FIELDS)
    return in_order(rows, "chunk_id", "seq").drop("seq").mapInArrow(run, "chunk_id long, raw_bytes long, gzip_bytes long")


def compared(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Of each chunk: rows, raw bytes, bytes encoded and by gzip, their ratios and bytes a row, and how many times gzip takes."""
    both = encode_chunks(obs, chunk).join(gzip_sizes(obs, chunk), "chunk_id").withColumn("chunk_bytes", F.octet_length("payload").cast("long"))
    return both.select(
        "chunk_id", "sample_count", "raw_bytes", "chunk_bytes", "gzip_bytes",
        (F.col("raw_bytes") / F.col("chunk_bytes")).alias("ratio"),
        (F.col("raw_bytes") / F.col("gzip_bytes")).alias("gzip_ratio"),
        (F.col("gzip_bytes") / F.col("chunk_bytes")).alias("times_better"),
        (F.col("chunk_bytes") / F.col("sample_count")).alias("bytes_per_row"),
    )


def header(payload: Column) -> Column:
    """version, sample_count and error of a chunk, from its first bytes alone: no decoding."""
    h = F.hex(F.substring(payload, 1, 9))
    le = F.concat(*[F.substring(h, k, 2) for k in (17, 15, 13, 11)])
    error = (
        F.when(F.octet_length(payload) < 5, "UnexpectedEof")
        .when(F.substring(h, 1, 8) != "4B524F47", "InvalidMagic")
        .when(F.octet_length(payload) < 9, "UnexpectedEof")
        .when(F.substring(h, 9, 2) != "01", "InvalidVersion")
    )
    return F.struct(
        F.conv(F.substring(h, 9, 2), 16, 10).cast("int").alias("version"),
        F.when(error.isNull(), F.conv(le, 16, 10).cast("long")).alias("sample_count"),
        error.alias("error_code"),
    )


def decode_udtf():
    """A table function ``decode_chunk(binary)``: good rows, then one row with the error."""
    from pyspark.sql.functions import udtf

    class DecodeChunk:
        def eval(self, payload: bytes):
            k = 0
            try:
                for k, row in enumerate(codec.decode_iter(bytes(payload)), 1):
                    yield (k - 1, codec.signed(row[0]), *row[1:], None)
            except CodecError as e:
                yield (k, *[None] * 6, str(e))

    return udtf(DecodeChunk, returnType=DECODED.split(", ", 1)[1])
