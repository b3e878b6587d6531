import random

import pytest
from geodelta import codec
from geodelta.codec import BitReader, BitWriter, StreamEncoder, decode, encode, unzz, zz
from geodelta.schema import CodecError
from hypothesis import given, settings
from hypothesis import strategies as st

BASE = 1_700_000_000_000


def constant(n):
    return [(BASE + i, 1, 42, 21_500_000_000, 1_200_500, None) for i in range(n)]


def smooth(n):
    return [(BASE + i, 1, 45 + i % 3, 21_500_000_000 + 5 * i, 1_200_000 + 2 * i, 100_000 + 16384 * i) for i in range(n)]


def noisy(n):
    x, mask, ts, out = 0xC0FFEE, (1 << 64) - 1, BASE, []

    def draw():
        nonlocal x
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        return x

    for i in range(n):
        a, b, c, d = draw(), draw(), draw(), draw()
        ts += 1 + a % 4
        doppler = 1_200_000 + draw() % 20001 - 10000
        phase = None if i % 5 == 0 else 1_000_000 + draw() % 50001 - 25000
        out.append((ts, b % 14 - 7, 20 + c % 40, 21_500_000_000 + d % 2001 - 1000, doppler, phase))
    return out


def bench_smooth(n):
    return [(BASE + i, 1, 42 + i % 5, 21_500_000_000 + 222 * i, 1_200_000 + 10 * i, 100_000 + i * 21 * 65536) for i in range(n)]


def bench_multi(n):
    return [(BASE + i, [-3, 0, 3, 6][i % 4], 38 + i % 8, 21_500_000_000 + 150 * i, 1_100_000 + 20 * i, None if i % 3 == 0 else 65536 * i) for i in range(n)]


@pytest.mark.parametrize(
    "rows,size",
    [(constant(512), 544), (smooth(512), 2155), (noisy(512), 6490), (bench_smooth(128), 571), (bench_smooth(1024), 4267), (bench_smooth(8192), 33835),
     (bench_multi(128), 1135), (bench_multi(1024), 8822), (bench_multi(8192), 70351), (constant(1), 32), (smooth(1), 40)],
)
def test_golden_sizes(rows, size):
    data = encode(rows)
    assert len(data) == size and decode(data) == rows and data[:5] == bytes.fromhex("4B524F4701")


big = st.integers(-(1 << 62), 1 << 62)
row = st.tuples(
    st.one_of(st.integers(BASE, BASE + 600), st.integers(0, (1 << 63) - 1)), st.integers(-7, 6), st.integers(0, 60),
    st.one_of(st.integers(21 * 10**9, 22 * 10**9), big), st.integers(-(1 << 31), (1 << 31) - 1), st.one_of(st.none(), st.integers(0, 10**6), st.integers(-(1 << 63), (1 << 63) - 1)),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(row, min_size=1, max_size=60))
def test_round_trip(rows):
    data = encode(rows)
    assert decode(data) == rows
    stream = StreamEncoder(1 << 20)
    for r in rows:
        stream.push(r)
    assert stream.flush() == data and stream.bytes_written() == len(data)


def test_stream_full_keeps_all_rows():
    rows = noisy(100)
    for capacity in (40, 64, 101, 200):
        e = StreamEncoder(capacity)
        done = []
        for r in rows:
            try:
                e.push(r)
                done.append(r)
            except CodecError as x:
                assert x.code == "BufferFull"
                break
        if done:
            assert decode(e.flush()) == done and len(e.flush()) <= capacity
    with pytest.raises(CodecError, match="BufferFull"):
        StreamEncoder(31).push(constant(1)[0])
    with pytest.raises(CodecError, match="EmptyChunk"):
        StreamEncoder(99).flush()


@pytest.mark.parametrize(
    "change,code",
    [(lambda d: d[:4], "UnexpectedEof"), (lambda d: b"\0" + d[1:], "InvalidMagic"), (lambda d: d[:4] + b"\x63" + d[5:], "InvalidVersion"), (lambda d: d[:-3], "UnexpectedEof"),
     (lambda d: d[:31] + b"\2" + d[32:], "InvalidPhaseFlag"), (lambda d: d[:17] + b"\x40" + d[18:], "InvalidSlot"), (lambda d: d[:18] + b"\x40" + d[19:], "InvalidDbHz")],
)
def test_corruption(change, code):
    with pytest.raises(CodecError) as e:
        decode(change(encode(smooth(50))))
    assert e.value.code == code


def test_errors_and_edges():
    for rows, code in (([], "EmptyChunk"), ([(1, 7, 1, 1, 1, None)], "InvalidSlot")):
        with pytest.raises(CodecError) as e:
            encode(rows)
        assert e.value.code == code
    with pytest.raises(CodecError, match="BufferFull"):
        decode(encode(constant(32)), 10)
    assert decode(codec.header(0)) == []
    assert decode(encode(smooth(9)) + b"tail") == smooth(9)
    assert [zz(v) for v in (0, -1, 1, -2, 2)] == [0, 1, 2, 3, 4] and all(unzz(zz(v)) == v for v in (-(1 << 63), (1 << 63) - 1))


def test_bits():
    for value, n, want in ((0x1234, 13, "91A0"), (0xABCDE, 20, "ABCDE0"), (1, 1, "80")):
        w = BitWriter()
        w.write(value, n)
        assert w.getvalue().hex().upper() == want
    with pytest.raises(CodecError, match="InvalidBitCount"):
        BitWriter().write(0, 65)
    with pytest.raises(CodecError, match="ValueTooLarge"):
        BitWriter().write(4, 2)
    with pytest.raises(CodecError, match="BufferFull"):
        BitWriter(1).write(0, 9)
    rng = random.Random(2)
    parts = [(rng.getrandbits(n), n) for n in (rng.randint(0, 64) for _ in range(2000))]
    w = BitWriter()
    for v, n in parts:
        w.write(v, n)
    r = BitReader(w.getvalue())
    assert [r.read(n) for _, n in parts] == [v for v, _ in parts]
    r.align()
    assert r.remaining() == 0
    with pytest.raises(CodecError, match="UnexpectedEof"):
        r.skip(1)
