"""The framed chunk log: each payload after its length, four bytes little-endian.

``FramedLog`` is a data source for reading and writing logs with ``format("framed")``, on local paths and on all stores that Arrow's file systems know
(file, hdfs, s3, gs, abfs); a log is read frame by frame, not as a whole. ``read_frames`` reads logs of any store that Spark reads, by
``format("binaryFile")``, a file in one row.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import FRAME_HEADER_LEN, FRAMES, MAX_FRAME_PAYLOAD, CodecError


def write_framed(payload: bytes) -> bytes:
    if len(payload) > MAX_FRAME_PAYLOAD:
        raise CodecError("InvalidInput", len(payload))
    return struct.pack("<I", len(payload)) + payload


def read_framed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at a place, and the bytes used."""
    if len(data) - at < FRAME_HEADER_LEN:
        raise CodecError("UnexpectedEof")
    (size,) = struct.unpack_from("<I", data, at)
    if size > MAX_FRAME_PAYLOAD:
        raise CodecError("ValueTooLarge", size)
    end = at + FRAME_HEADER_LEN + size
    if len(data) < end:
        raise CodecError("UnexpectedEof")
    return bytes(data[at + FRAME_HEADER_LEN : end]), FRAME_HEADER_LEN + size


def frames_of(path: str, data: bytes) -> Iterator[tuple]:
    """Frames in order; after an error, which is given once, nothing more."""
    at = k = 0
    while at < len(data):
        try:
            payload, used = read_framed(data, at)
        except CodecError as e:
            yield path, k, at, None, None, str(e)
            return
        yield path, k, at, len(payload), payload, None
        at += used
        k += 1


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All frames of the logs under a path: path, frame_no, byte_offset, payload_len, payload, error. One task a file."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(frames_of(name, data))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.frames").load(path)
    return files.select("path", "content").mapInArrow(run, FRAMES)


@dataclass
class LogFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str
    chunks: int
    size: int


def store(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return afs.FileSystem.from_uri(path)
    return afs.LocalFileSystem(), path.removeprefix("file:")


def _files(fs: afs.FileSystem, folder: str, ends: str) -> list[str]:
    found = fs.get_file_info(afs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == afs.FileType.File and f.path.endswith(ends))


def stream_frames(path: str, file) -> Iterator[tuple]:
    """Frames of an open file, one after another; as ``frames_of``."""
    at = k = 0
    while head := file.read(FRAME_HEADER_LEN):
        try:
            if len(head) < FRAME_HEADER_LEN:
                raise CodecError("UnexpectedEof")
            (size,) = struct.unpack("<I", head)
            if size > MAX_FRAME_PAYLOAD:
                raise CodecError("ValueTooLarge", size)
            payload = file.read(size)
            if len(payload) < size:
                raise CodecError("UnexpectedEof")
        except CodecError as e:
            yield path, k, at, None, None, str(e)
            return
        yield path, k, at, size, payload, None
        at += FRAME_HEADER_LEN + size
        k += 1


class FramedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[LogFile]:
        fs, folder = store(self.path)
        return [LogFile(f) for f in _files(fs, folder, ".frames")]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        fs, _ = store(self.path)
        with fs.open_input_stream(partition.path) as f:
            yield from stream_frames(partition.path, f)


class FramedWriter(DataSourceWriter):
    """One log a partition, renamed into place at commit; the counters of each write in a manifest of its own.

    Overwriting first puts the new logs in place and then removes the old ones, so a failure between loses nothing."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        fs, folder = store(self.path)
        fs.create_dir(folder)
        path = posixpath.join(folder, f"{uuid.uuid4().hex}.tmp")
        chunks = size = 0
        with fs.open_output_stream(path) as f:
            for row in iterator:
                frame = write_framed(bytes(row["payload"]))
                f.write(frame)
                size += len(frame)
                chunks += 1
        return Written(path, chunks, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = store(self.path)
        old = [*_files(fs, folder, ".frames"), *_files(fs, folder, ".manifest")] if self.overwrite else []
        lines = []
        for m in messages:
            if m is not None:
                done = m.path.removesuffix(".tmp") + ".frames"
                fs.move(m.path, done)
                lines.append(f"{posixpath.basename(done)} {m.chunks} {m.size}\n")
        with fs.open_output_stream(posixpath.join(folder, f"_{uuid.uuid4().hex}.manifest")) as f:
            f.write("".join(lines).encode())
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = store(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.path).type == afs.FileType.File:
                fs.delete_file(m.path)


def counters(spark: SparkSession, path: str) -> DataFrame:
    """What the writers of a log counted: file, chunks_written, bytes_written (with the headers), a row for each file of all its writes."""
    fs, folder = store(path)
    rows = []
    for manifest in _files(fs, folder, ".manifest"):
        with fs.open_input_stream(manifest) as f:
            rows += [(name, int(n), int(size)) for name, n, size in map(str.split, f.read().decode().splitlines())]
    return spark.createDataFrame(rows, "file string, chunks_written long, bytes_written long")


class FramedLog(DataSource):
    """format("framed"): for paths and URIs that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FramedReader:
        return FramedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> FramedWriter:
        return FramedWriter(self.options["path"], overwrite)
