"""Doppler codecs of the multi-system registry: last value per satellite (CDMA), slow average per slot (FDMA), anew in each chunk.

A chunk's rows share one stream of bits. Encoding and decoding take many chunks of a partition at once: the averages, a true recurrence, go
step by step over all (chunk, slot) groups together, and decoding over all chunks together, so work is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vector
from ..functions.bits import bit_string, fits, zigzag
from ..schema import EMA_SHIFT, SYSTEMS
from .chunks import byte_slices, group_starts, in_order, whole_groups

#: Each system's first lane and its lowest id; a lane is a state of the registry.
LANES: dict[str, tuple[int, int]] = {}
_at = 0
for _name, (_low, _high, *_rest) in SYSTEMS.items():
    LANES[_name] = (_at, _low)
    _at += _high - _low + 1
ALL_LANES = _at
FDMA_LANES = LANES["GPS"][0]
#: Satellite of each lane.
LANE_SYSTEM = [name for name, (low, high, *_) in SYSTEMS.items() for _ in range(low, high + 1)]
LANE_ID = [i for low, high, *_ in SYSTEMS.values() for i in range(low, high + 1)]

ENCODED = "chunk_id long, sample_count long, lanes binary, n_bits long, payload binary, error_code string"
DECODED = "chunk_id long, seq long, constellation string, sat_id int, doppler_millihz int, error_code string"
RESIDUALS = "chunk_id long, seq long, slot int, v long, before long, residual long, base long, n_bits int"


def lanes_of(system: pa.ChunkedArray, ids: np.ndarray) -> np.ndarray:
    """Lanes by system and id; -1 where there is none."""
    names = system.combine_chunks().dictionary_encode()
    out = np.full(len(ids), -1)
    known = [LANES.get(n) for n in names.dictionary.to_pylist()]
    ends = [SYSTEMS[n][1] if n in SYSTEMS else 0 for n in names.dictionary.to_pylist()]
    code = names.indices.fill_null(-1).to_numpy()
    for k, lane in enumerate(known):
        if lane:
            fit = (code == k) & (ids >= lane[1]) & (ids <= ends[k])
            out[fit] = lane[0] + ids[fit] - lane[1]
    return out


def wrap32(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint64).astype(np.uint32).view(np.int32).astype(np.int64)


def averages(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(average before or the value itself, residual, average after) of rows in order, for each group on its own."""
    order = np.argsort(groups, kind="stable")
    first = np.append(True, groups[order][1:] != groups[order][:-1]) if len(order) else np.zeros(0, bool)
    begins = np.flatnonzero(first)
    sizes = np.diff(np.append(begins, len(order)))
    by = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by], sizes[by]
    before, residual, after = (np.zeros(len(values), np.int64) for _ in range(3))
    base = values[order[begins]].copy() if len(begins) else np.zeros(0, np.int64)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k))
        at = order[begins[:m] + k]
        v = values[at]
        before[at] = base[:m]
        r = wrap32(v - base[:m])
        residual[at] = r
        large = vector.zigzag(r) >= np.uint64(1 << 14)
        base[:m] = np.where(large, v, base[:m] + ((v - base[:m]) >> EMA_SHIFT))
        after[at] = base[:m]
    return before, residual, after


def stream_fields(values: np.ndarray, lanes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bits as a value and a width."""
    groups = owner * ALL_LANES + lanes
    old, known = vector.last_of_lane(groups, values)
    fdma = lanes < FDMA_LANES
    residual = values - old
    if fdma.any():
        _, slow, _ = averages(values[fdma], groups[fdma])
        residual[fdma] = slow
    z = vector.zigzag(residual)
    small = np.where(fdma, 14, 16).astype(np.uint64)
    raw = (values & 0xFFFFFFFF).astype(np.uint64)
    near = z >> small == 0
    value = np.where(~known, raw, np.where(residual == 0, np.uint64(0b10), np.where(near, np.uint64(0b110) << small | z, np.uint64(0b111 << 32) | raw)))
    width = np.where(~known, 33, np.where(residual == 0, 2, np.where(near, small.astype(np.int64) + 3, 35)))
    return value, width


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of chunks, chunk of each row, lanes (-1 for none) and values."""
    starts = np.append(group_starts(table["chunk_id"]), table.num_rows)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ids = table["sat_id"].cast(pa.int64()).fill_null(-(1 << 40)).to_numpy()
    return starts, owner, lanes_of(table["constellation"], ids), table["doppler_millihz"].cast(pa.int64()).fill_null(0).to_numpy()


def encode_doppler(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """One row a chunk: its Doppler values in the order of ``seq`` as one stream, with the lane of each row. A row of no known satellite or without a value gives its chunk an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "chunk_id"):
            starts, owner, lanes, values = _columns(table)
            value, width = stream_fields(values, lanes, owner)
            chunks = len(starts) - 1
            payloads = vector.pack(value, width, owner, chunks)
            errors: list[str | None] = [None] * chunks
            for k in np.unique(owner[(lanes < 0) | table["doppler_millihz"].is_null().to_numpy()]).tolist():
                errors[k] = "InvalidSatellite" if (lanes[starts[k] : starts[k + 1]] < 0).any() else "NullValue"
            good = lambda x: [None if e else v for v, e in zip(x, errors)]
            bits = np.bincount(owner, width, chunks).astype(np.int64).tolist()
            shown = [lanes[a:b].astype(np.uint8).tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    table["chunk_id"].combine_chunks().take(pa.array(starts[:-1])),
                    pa.array(np.diff(starts)),
                    pa.array(good(shown), pa.binary()),
                    pa.array(good(bits), pa.int64()),
                    pa.array(good(payloads), pa.binary()),
                    pa.array(errors, pa.string()),
                ],
                [c.split()[0] for c in ENCODED.split(", ")],
            )

    rows = obs.select(F.col(chunk).cast("long").alias("chunk_id"), "seq", "constellation", "sat_id", "doppler_millihz")
    return in_order(rows, "chunk_id", "seq").drop("seq").mapInArrow(run, ENCODED)


def decode_streams(payloads: list[bytes], lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by chunk and row, the rows decoded of each chunk, and 0, or 1 (the stream ends too soon) or 2 (a wrong first bit) where it stopped."""
    n, count = len(payloads), np.array([len(x) for x in lanes], np.int64)
    order = np.argsort(-count, kind="stable")
    bits = vector.Bits([payloads[i] for i in order])
    size = count[order]
    most = int(size[0]) if n else 0
    table = np.zeros((n, max(most, 1)), np.int64)
    for k, i in enumerate(order):
        table[k, : len(lanes[i])] = lanes[i]
    base, known = np.zeros((n, ALL_LANES), np.int64), np.zeros((n, ALL_LANES), bool)
    out, at = np.zeros((n, max(most, 1)), np.int64), np.zeros(n, np.int64)
    done, code = size.copy(), np.zeros(n, np.int64)
    for k in range(most):
        who = np.flatnonzero((size > k) & (code == 0))
        lane = table[who, k]
        x, left = bits.window(who, at[who]), bits.end[who] - at[who]
        old, had, fdma = base[who, lane], known[who, lane], lane < FDMA_LANES
        tag, small = x >> np.uint64(61), np.where(fdma, 14, 16)
        whole = ~had | (tag == 7)
        raw = wrap32(x >> np.where(had, 29, 31).astype(np.uint64))
        z = x << np.uint64(3) >> (64 - small).astype(np.uint64)
        moved = wrap32(old + np.where(tag == 6, vector.unzigzag(z), 0))
        value = np.where(whole, raw, moved)
        used = np.where(~had, 33, np.where(tag == 7, 35, np.where(tag == 6, small + 3, 2)))
        wrong = ~had & ~fdma & (x >> np.uint64(63) == 1) & (left > 0)
        short = (used > left) | had & (tag < 4)
        stop = np.where(wrong, 2, np.where(short, 1, 0))
        code[who], done[who] = stop, np.where(stop > 0, k, done[who])
        slow = wrap32(old + ((value - old) >> EMA_SHIFT))
        base[who, lane], known[who, lane] = np.where(whole | ~fdma, value, slow), True
        out[who, k] = value
        at[who] += used
    back = np.argsort(order, kind="stable")
    return out[back], done[back], code[back]


def decode_doppler(encoded: DataFrame) -> DataFrame:
    """The rows of all chunks from their bits alone, numbered within the chunk: good rows, and then one with the error if there is one."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in DECODED.split(", ")]
    systems, ids = np.array([*LANE_SYSTEM, None], object), np.array([*LANE_ID, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "lanes", 1 << 16):
            lanes = [np.frombuffer(b, np.uint8) for b in batch.column("lanes").to_pylist()]
            values, done, code = decode_streams(batch.column("payload").to_pylist(), lanes)
            sizes = done + (code > 0)
            if not sizes.sum():
                continue
            of = np.repeat(np.arange(len(sizes)), sizes)
            number = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bad = number == done[of]
            lane = np.concatenate([np.append(x[:d], ALL_LANES) if c else x[:d] for x, d, c in zip(lanes, done.tolist(), code.tolist())]).astype(np.int64)
            errors = np.array([None, "UnexpectedEof", "InvalidBitPattern"], object)[np.where(bad, code[of], 0)]
            shown = values[of, np.minimum(number, values.shape[1] - 1)]
            columns = [batch.column("chunk_id").take(pa.array(of)), pa.array(number), pa.array(systems[lane]), pa.array(ids[lane], mask=bad), pa.array(shown, mask=bad), pa.array(errors)]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names)

    return encoded.filter("payload is not null").select("chunk_id", "lanes", "payload").mapInArrow(run, DECODED)


def fdma_residuals(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Each row's slow average of its slot before and after, residual and size in bits; averages start anew in each chunk.

    The average moves by 1/128 of the residual, rounded down; an absolute bucket starts it anew. ``before`` is null in a slot's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "chunk_id"):
            starts = np.append(group_starts(table["chunk_id"]), table.num_rows)
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            groups = owner * 64 + table["slot"].to_numpy()
            values = table["v"].to_numpy()
            before, residual, after = averages(values, groups)
            _, known = vector.last_of_lane(groups, values)
            z = vector.zigzag(residual)
            size = np.where(~known, 33, np.where(residual == 0, 2, np.where(z < np.uint64(1 << 14), 17, 35))).astype(np.int32)
            columns = [table[c].combine_chunks() for c in ("chunk_id", "seq", "slot", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, mask=~known), pa.array(residual), pa.array(after), pa.array(size)], [c.split()[0] for c in RESIDUALS.split(", ")])

    rows = obs.select(F.col(chunk).cast("long").alias("chunk_id"), "seq", F.col("slot").cast("int").alias("slot"), F.col("doppler_millihz").cast("long").alias("v"))
    return in_order(rows.filter("slot is not null and v is not null"), "chunk_id", "seq").mapInArrow(run, RESIDUALS)


def cdma_bits(obs: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """The satellite's residual, its size in bits and its bits, by window columns: a lag over each satellite's rows of a chunk."""
    w = Window.partitionBy(chunk, "constellation", "sat_id").orderBy("seq")
    v = F.col("doppler_millihz").cast("long")
    out = obs.withColumn("residual", v - F.lag(v).over(w))
    z = zigzag(F.col("residual"))
    size = F.when(F.col("residual").isNull(), 33).when(F.col("residual") == 0, 2).when(fits(z, 16), 19).otherwise(35)
    out = out.withColumn("n_bits", size.cast("int"))
    bits = (
        F.when(F.col("n_bits") == 33, F.concat(F.lit("0"), bit_string(v, 32)))
        .when(F.col("n_bits") == 2, F.lit("10"))
        .when(F.col("n_bits") == 19, F.concat(F.lit("110"), bit_string(z, 16)))
        .otherwise(F.concat(F.lit("111"), bit_string(v, 32)))
    )
    return out.withColumn("bits", bits)
