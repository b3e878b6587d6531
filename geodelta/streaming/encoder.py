"""Incremental encoding: a stateful processor that rolls over to a new chunk when the next row does not fit.

The state of a track is plain fields, so a later version of the code can read it. What a track has not yet filled a chunk with (its rest) is
given at the end of each batch, or when no row came for a time, or kept until the chunk is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..codec import BitWriter, State, StreamEncoder
from ..operators.chunks import FIELDS
from ..schema import MIN_BUFFER_PHASE, SLOT_MIN, SLOTS, CodecError

OUTPUT = "track_id long, chunk_no long, sample_count long, payload binary"
STATE = (
    "no long, count long, first binary, stream binary, n_bits long, ts long, slot int, cn0 int, pr long, d_ts long, d_pr long, "
    "phase long, d_phase long, doppler array<int>"
)
RESTS = ("batch", "idle", "keep")


def to_fields(no: int, e: StreamEncoder) -> tuple:
    """An encoder as the fields of ``STATE``."""
    s = e.state
    if s is None:
        return (no, 0, b"", b"", 0, *[None] * 8, [])
    lanes = [s.doppler.get(k + SLOT_MIN) for k in range(SLOTS)]
    ts = s.ts - (1 << 64) if s.ts >> 63 else s.ts
    return no, e.count, e.first, e.stream.getvalue(), e.stream.bit_len(), ts, s.slot, s.cn0, s.pr, s.d_ts, s.d_pr, s.phase, s.d_phase, lanes


def from_fields(fields: tuple, capacity: int) -> tuple[int, StreamEncoder]:
    no, count, first, stream, n_bits, ts, slot, cn0, pr, d_ts, d_pr, phase, d_phase, lanes = fields
    e = StreamEncoder(capacity)
    if count:
        e.count, e.first = count, bytes(first)
        e.stream = BitWriter.from_state(bytes(stream), n_bits // 8, n_bits % 8)
        e.state = State((ts, slot, cn0, pr, 0, phase))
        e.state.d_ts, e.state.d_pr, e.state.d_phase = d_ts, d_pr, d_phase
        e.state.doppler = {k + SLOT_MIN: v for k, v in enumerate(lanes) if v is not None}
    return no, e


class ChunkProcessor(StatefulProcessor):
    """Per track: the encoder so far. A chunk is given when it is full (by bytes or rows), and the rest as asked for."""

    def __init__(self, max_bytes: int, max_rows: int, rest: str, idle_ms: int):
        self.max_bytes, self.max_rows, self.rest, self.idle_ms = max_bytes, max_rows, rest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("encoder", STATE)

    def _load(self) -> tuple[int, StreamEncoder]:
        return from_fields(self.state.get(), self.max_bytes) if self.state.exists() else (0, StreamEncoder(self.max_bytes))

    def _given(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(out, columns=["track_id", "chunk_no", "sample_count", "payload"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        no, encoder = self._load()
        out = []
        table = pd.concat(list(rows)).sort_values("seq")
        for row in table[list(FIELDS)].itertuples(index=False):
            row = (*[int(v) for v in row[:5]], None if pd.isna(row[5]) else int(row[5]))
            try:
                full = encoder.count >= self.max_rows
                if not full:
                    encoder.push(row)
            except CodecError as e:
                if e.code != "BufferFull" or not encoder.count:
                    raise
                full = True
            if full:
                out.append((key[0], no, encoder.count, encoder.flush()))
                no, encoder = no + 1, StreamEncoder(self.max_bytes)
                encoder.push(row)
        if self.rest == "batch" and encoder.count:
            out.append((key[0], no, encoder.count, encoder.flush()))
            no, encoder = no + 1, StreamEncoder(self.max_bytes)
        self.state.update(to_fields(no, encoder))
        if self.rest == "idle":
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        no, encoder = self._load()
        out = []
        if encoder.count:
            out.append((key[0], no, encoder.count, encoder.flush()))
            self.state.update(to_fields(no + 1, StreamEncoder(self.max_bytes)))
        yield from self._given(out)

    def close(self) -> None:
        pass


def stream_chunks(obs: DataFrame, max_bytes: int = 1 << 16, max_rows: int = 512, rest: str = "keep", idle_ms: int = 60_000) -> DataFrame:
    """Chunks of each track. ``rest``: rows that do not fill a chunk are given at the end of each batch (``batch``), after ``idle_ms`` without a
    row of the track (``idle``), or kept for the next rows (``keep``). Carrier phase travels as a string so that pandas keeps all its bits."""
    if max_bytes < MIN_BUFFER_PHASE:
        raise CodecError("BufferFull", max_bytes)
    if rest not in RESTS:
        raise ValueError(f"rest is one of {RESTS}")
    rows = obs.select("track_id", "seq", *FIELDS[:-1], F.col(FIELDS[-1]).cast("string").alias(FIELDS[-1]))
    return rows.groupBy("track_id").transformWithStateInPandas(
        statefulProcessor=ChunkProcessor(max_bytes, max_rows, rest, idle_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="ProcessingTime" if rest == "idle" else "None",
    )
