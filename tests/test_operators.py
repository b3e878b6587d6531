import os

import pytest
from geodelta.functions import bits, satellites, validation
from geodelta.operators import chunks, epochs, wire
from geodelta.plans import buckets
from geodelta.schema import CodecError
from geodelta.sources import framed
from geodelta.streaming.encoder import stream_chunks
from pyspark.sql import functions as F

from .test_codec import bench_multi, noisy

SCHEMA = "chunk_id long, track_id long, seq long, timestamp_ms long, slot int, cn0_dbhz int, pseudorange_mm long, doppler_millihz int, carrier_phase_cycles long"


def table(spark, rows, chunk=0):
    return spark.createDataFrame([(chunk, chunk, i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_sizes_by_windows_and_packer(spark):
    for rows, size in ((noisy(512), 6490), (bench_multi(1024), 8822)):
        o = table(spark, rows).repartition(3)
        assert buckets.chunk_sizes(o).first()["chunk_bytes"] == size
        assert len(chunks.encode_chunks(o).first()["payload"]) == size


def test_phase_fold_after_absolute_bucket(spark):
    phases = [0, 10, 1 << 40, (1 << 40) + 7, (1 << 40) + 14, None, None, 5, 6]
    o = table(spark, [(i, 1, 40, 1, 1, p) for i, p in enumerate(phases)])
    kinds = [r["kind"] for r in buckets.phase_kinds(o).orderBy("seq").collect()]
    assert kinds == [-1, 4, 5, 4, 3, 1, 0, 2, 4]


def test_display_and_carriers(spark):
    rows = spark.createDataFrame([("GPS", 5), ("GLO", 1), ("GLO", -7), ("GLO", 6)], "c string, s int")
    assert [r[0] for r in rows.select(satellites.display_id(F.col("c"), F.col("s"))).collect()] == ["GPS05", "GLO08", "GLO00", "GLO13"]
    hz = [r[0] for r in rows.select(satellites.carrier_freq_hz(F.col("s"))).collect()]
    assert hz[1:] == [1_602_562_500, 1_598_062_500, 1_605_375_000]


def test_validation_modes(spark):
    rows = spark.createDataFrame([("GLO", 9, 1, 1), ("GLO", 1, 1, 1), ("GLO", 1, 20_000_000_000, -6_000_000), ("GPS", 32, 20_200_000_000, 6_000_000)], "constellation string, sat_id int, pseudorange_mm long, doppler_millihz int")
    out = validation.validate(rows, validation.observation_error()).collect()
    assert [(r["error_code"], r["error_value"]) for r in out] == [("InvalidSlot", 9), ("InvalidPseudorange", 1), ("InvalidDoppler", 6_000_000), (None, None)]
    assert validation.validate(rows, validation.observation_error(), "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="InvalidSlot"):
        validation.validate(rows.coalesce(1), validation.observation_error(), "FAILFAST").collect()
    zero = spark.range(1).select(satellites.zeroed().alias("z")).select("z.*").withColumn("constellation", F.lit("GLO"))
    assert validation.validate(zero, validation.observation_error()).first()["error_code"] == "InvalidPseudorange"


def test_decode_modes(spark):
    good = chunks.encode_chunks(table(spark, noisy(30)))
    bad = good.withColumn("payload", F.expr("substring(payload, 1, octet_length(payload) - 6)"))
    out = chunks.decode_chunks(bad).orderBy("seq").collect()
    assert out[-1]["error_code"] == "UnexpectedEof" and 20 < len(out) <= 30
    assert chunks.decode_chunks(bad, "DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="UnexpectedEof"):
        chunks.decode_chunks(bad, "FAILFAST").collect()
    spark.udtf.register("decode_chunk", chunks.decode_udtf())
    good.createOrReplaceTempView("one_chunk")
    assert spark.sql("SELECT d.* FROM one_chunk, LATERAL decode_chunk(payload) d").count() == 30


def test_nulls_are_errors(spark):
    rows = noisy(40)
    o = table(spark, rows).unionByName(table(spark, [(1, 1, 40, None, 1, None), (2, 1, 40, 5, 1, 7)], 1)).unionByName(table(spark, [(5, None, 40, 5, 1, 7)], None))
    out = {r["chunk_id"]: r for r in chunks.encode_chunks(o.repartition(3)).collect()}
    assert out[0]["error_code"] is None and [out[k]["error_code"] for k in (1, None)] == ["NullValue"] * 2 and out[1]["payload"] is None
    with pytest.raises(Exception, match="NullValue"):
        chunks.encode_chunks(o, mode="FAILFAST").collect()
    null = spark.createDataFrame([(None, 1, 1), (1, None, 1), (1, 20_200_000_000, None)], "sat_id int, pseudorange_mm long, doppler_millihz int")
    got = validation.validate(null, validation.system_error("GPS")).collect()
    assert [r["error_message"] for r in got] == ["InvalidPrn(null)", "InvalidPseudorange(null)", "InvalidDoppler(null)"]


def test_chunks_of_many_batches(spark):
    """A long chunk over many Arrow batches, between short ones."""
    o = table(spark, bench_multi(30_000), 5)
    for k in range(4):
        o = o.unionByName(table(spark, noisy(50), k))
    out = {r["chunk_id"]: r["sample_count"] for r in chunks.encode_chunks(o).collect()}
    assert out == {0: 50, 1: 50, 2: 50, 3: 50, 5: 30_000}
    assert chunks.decode_chunks(chunks.encode_chunks(o), "FAILFAST").count() == 30_200


def test_gzip_comparison(spark):
    import gzip

    from geodelta.codec import encode, verbatim

    rows = noisy(100)
    got = chunks.compared(table(spark, rows)).first()
    plain = b"".join(map(verbatim, rows))
    want = (100, len(plain), len(encode(rows)), len(gzip.compress(plain, 6)))
    assert (got["sample_count"], got["raw_bytes"], got["chunk_bytes"], got["gzip_bytes"]) == want
    assert got["times_better"] == want[3] / want[2]


def test_frame_inserts(spark):
    rows = [(1, 100, 8), (2, 100, 1), (3, 101, 2), (4, 100, 1), *[(5 + k, 100, k - 7) for k in range(14) if k != 8], (30, 100, 1)]
    o = spark.createDataFrame([(0, *r) for r in rows], "frame_id int, seq long, timestamp_ms long, slot int")
    out = {r["seq"]: r["error_code"] for r in epochs.insert_errors(o).collect()}
    assert (out[1], out[2], out[3], out[4], out[30]) == ("InvalidSlot", None, "TimestampMismatch", "DuplicateSlot", "FrameFull")
    assert [v for k, v in out.items() if 5 <= k < 30] == [None] * 13


def test_frames(spark, tmp_path):
    parts = [b"first", b"", b"third"]
    data = b"".join(map(framed.write_framed, parts))
    assert [f[4] for f in framed.frames_of("x", data)] == parts
    cut = list(framed.frames_of("x", data[:-1]))
    assert [f[5] for f in cut] == [None, None, "UnexpectedEof"]
    assert list(framed.frames_of("x", b"\x01\x00\x00\x04"))[0][5].startswith("ValueTooLarge")
    with pytest.raises(CodecError):
        framed.write_framed(b"x" * ((64 << 20) + 1))
    spark.dataSource.register(framed.FramedLog)
    rows = spark.createDataFrame([(bytes(p),) for p in parts], "payload binary")
    path = str(tmp_path / "log")
    for _ in range(2):
        rows.write.format("framed").mode("overwrite").option("path", path).save()
    got = spark.read.format("framed").option("path", path).load()
    assert sorted(bytes(r["payload"]) for r in got.collect()) == sorted(parts)
    assert not [f for f in os.listdir(path) if f.endswith(".tmp")]
    assert framed.counters(spark, path).selectExpr("sum(chunks_written)", "sum(bytes_written)").first() == (3, len(data))
    rows.write.format("framed").mode("append").option("path", f"file://{path}").save()
    assert framed.counters(spark, path).selectExpr("sum(chunks_written)", "sum(bytes_written)").first() == (6, 2 * len(data))
    with open(f"{path}/z.frames", "wb") as f:
        f.write(data[:-1])
    errors = spark.read.format("framed").option("path", path).load().filter("error is not null").collect()
    assert [(r["frame_no"], r["error"]) for r in errors] == [(2, "UnexpectedEof")]


def test_frame_from_rows(spark):
    rows = [(0, 1, 5, 2), (0, 2, 5, -7), (1, 3, 5, 2), (1, 4, 5, 2), (1, 5, 6, 1), (2, 6, 7, 9)]
    o = spark.createDataFrame([(*r, 1, 1, 1, None) for r in rows], "frame_id int, seq long, timestamp_ms long, slot int, cn0_dbhz int, pseudorange_mm long, doppler_millihz int, carrier_phase_cycles long")
    out = {r["frame_id"]: r for r in epochs.frames(o).collect()}
    assert [out[k]["error_code"] for k in range(3)] == [None, "DuplicateSlot", "InvalidSlot"]
    assert [x["seq"] for x in out[0]["observations"]] == [2, 1] and (out[0]["min_slot"], out[0]["max_slot"], out[1]["n"]) == (-7, 2, 0)
    part = epochs.frames(o, partial=True)
    assert {r["frame_id"]: (r["n"], r["error_code"]) for r in part.collect()} == {0: (2, None), 1: (1, "DuplicateSlot"), 2: (0, "InvalidSlot")}
    shown = {r["timestamp_ms"]: r["error_code"] for r in epochs.to_epochs(part.drop("error_code")).collect()}
    assert shown == {5: None, 7: "EmptyChunk"}


def test_compatibility(spark):
    out = spark.range(1, 4).select(wire.compatibility(F.lit(1), F.col("id").cast("int")).alias("x")).select("x.*").collect()
    assert [r["readable"] for r in out] == [True, False, False] and [len(r["warnings"]) for r in out] == [0, 2, 2]


def test_pack_hex(spark):
    r = spark.createDataFrame([("1010",), ("",), ("111111110",)], "b string").select(bits.pack_hex(F.col("b"))).collect()
    assert [x[0] for x in r] == ["A0", "", "FF00"]


@pytest.mark.parametrize("rest,chunks_wanted", [("keep", [30, 30, 30]), ("batch", [30, 30, 30, 10])])
def test_stream_equals_batch(spark, tmp_path, rest, chunks_wanted):
    from geodelta.codec import encode

    rows = noisy(100)
    table(spark, rows, 4).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        q = (
            stream_chunks(stream, max_rows=30, rest=rest).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
        return {r["chunk_no"]: bytes(r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    edges = [0, *(sum(chunks_wanted[: k + 1]) for k in range(len(chunks_wanted)))]
    want = {k: encode(rows[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))}
    assert run() == want
    if rest == "keep":  # the ten that were left go on in a second run, from the state
        more = noisy(125)[100:]
        spark.createDataFrame([(4, 4, 100 + i, *r) for i, r in enumerate(more)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run() == want | {3: encode(noisy(125)[90:120])}


def test_state_fields_go_on():
    from geodelta.codec import StreamEncoder, encode
    from geodelta.streaming.encoder import from_fields, to_fields

    rows = noisy(60)
    e, no = StreamEncoder(1 << 16), 0
    for r in rows:
        no, e = from_fields(to_fields(no, e), 1 << 16)
        e.push(r)
    assert e.flush() == encode(rows) and from_fields(to_fields(7, StreamEncoder(99)), 99)[0] == 7
