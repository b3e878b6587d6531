"""Arrays against plain numbers: chunk codec and Doppler codecs."""

import random

import numpy as np
import pytest
from geodelta import codec, vector
from geodelta.codec import BitReader, BitWriter
from geodelta.doppler_codec import Registry
from geodelta.operators import doppler
from geodelta.schema import SYSTEMS, CodecError

from .test_codec import BASE, bench_multi, bench_smooth, constant, noisy, smooth


def columns(chunks):
    rows = [r for c in chunks for r in c]
    column = lambda k: np.array([codec.signed(r[k]) for r in rows], np.int64)
    held = np.array([r[5] is not None for r in rows])
    starts = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
    return vector.Rows(*(column(k) for k in range(5)), np.array([r[5] or 0 for r in rows], np.int64), held), starts


def odd_rows(rng, n):
    out = []
    for i in range(n):
        ts = BASE + i if rng.random() < 0.9 else rng.getrandbits(63)
        phase = i * 65536 if rng.random() < 0.5 else rng.choice([None, i * 1000, (1 << 40) * rng.randint(0, 2) + i * 7, rng.getrandbits(64) - (1 << 63)])
        pr = 21 * 10**9 + rng.choice([i, 0, rng.getrandbits(25)]) if rng.random() < 0.9 else rng.getrandbits(62)
        out.append((ts, rng.randint(-7, 6), rng.randint(0, 60), pr, rng.choice([5, 1000 + i, rng.getrandbits(32) - (1 << 31)]), phase))
    return out


def decoded(payloads):
    rows, of, number = vector.decode(payloads)
    out = {}
    for i, (k, j) in enumerate(zip(of.tolist(), number.tolist())):
        assert len(out.setdefault(k, [])) == j
        out[k].append(rows.row(i))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_like_plain_numbers(seed):
    rng = random.Random(seed)
    chunks = [odd_rows(rng, rng.choice([1, 2, 3, 10, 50, 300])) for _ in range(150)]
    chunks += [noisy(512), smooth(512), constant(512), bench_multi(1024), bench_smooth(128)]
    payloads, errors = vector.encode(*columns(chunks))
    assert not any(errors) and payloads == [codec.encode(c) for c in chunks]
    assert decoded(payloads) == {k: [(codec.signed(r[0]), *r[1:]) for r in c] for k, c in enumerate(chunks)}
    broken = []
    for p in payloads:
        b = bytearray(p)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] ^= 1 << rng.randrange(8)
        broken.append(bytes(b)[: rng.choice([len(b), len(b), max(0, len(b) - rng.randint(0, 9))])])
    got = decoded(broken)
    for k, p in enumerate(broken):
        rows, error = vector.whole(p)
        assert got.get(k, []) == ([(codec.signed(r[0]), *r[1:]) for r in rows] if error is None else [])


def test_bad_rows():
    good = constant(3)
    chunks = [good, [good[0], (1, 9, 70, 1, 1, None), (1, 8, 1, 1, 1, None)], [(1, 1, 61, 1, 1, None)], good]
    payloads, errors = vector.encode(*columns(chunks))
    assert [str(e) for e in errors] == ["None", "InvalidSlot(9)", "InvalidDbHz(61)", "None"]
    assert payloads == [codec.encode(good), None, None, codec.encode(good)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_doppler_like_plain_numbers(seed):
    rng = random.Random(seed)
    chunks = []
    for _ in range(40):
        ids = [(s, rng.randint(SYSTEMS[s][0], SYSTEMS[s][1])) for s in rng.choices(list(SYSTEMS), k=6)]
        walk = {i: rng.randint(-5_000_000, 5_000_000) for i in ids}
        rows = []
        for _ in range(rng.randint(1, 80)):
            i = rng.choice(ids)
            walk[i] += rng.choice([0, 0, 3, -200, 9000, 40000])
            rows.append((i, walk[i] if rng.random() < 0.95 else rng.getrandbits(32) - (1 << 31)))
        chunks.append(rows)
    owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
    lanes = [np.array([doppler.LANES[s][0] + i - doppler.LANES[s][1] for (s, i), _ in c]) for c in chunks]
    value, width = doppler.stream_fields(np.array([v for c in chunks for _, v in c], np.int64), np.concatenate(lanes), owner)
    payloads = vector.pack(value, width, owner, len(chunks))
    registry = Registry()
    for rows, p in zip(chunks, payloads):
        registry.reset()
        w = BitWriter()
        for i, v in rows:
            registry.encode(w, v, i)
        assert w.getvalue() == p
    broken = [bytes(b ^ (rng.random() < 0.02) * (1 << rng.randrange(8)) for b in p)[: len(p) - rng.choice([0, 0, 1, 5])] for p in payloads]
    for streams in (payloads, broken):
        values, done, code = doppler.decode_streams(streams, lanes)
        for k, (rows, p) in enumerate(zip(chunks, streams)):
            registry.reset()
            reader, got, error = BitReader(p), [], 0
            for i, _ in rows:
                try:
                    got.append(registry.decode(reader, i))
                except CodecError as e:
                    error = {"UnexpectedEof": 1, "InvalidBitPattern": 2}[e.code]
                    break
            assert (values[k, : done[k]].tolist(), done[k], code[k]) == (got, len(got), error)
        if streams is payloads:
            assert [values[k, : done[k]].tolist() for k in range(len(chunks))] == [[v for _, v in c] for c in chunks]


def test_writer_goes_on():
    w = BitWriter(4)
    w.write(0b10110, 5)
    w.write(0x1FF, 9)
    assert (w.byte_pos(), w.bit_pos(), w.bits_available()) == (1, 6, 18)
    v = BitWriter.from_state(w.getvalue(), w.byte_pos(), w.bit_pos(), 4)
    for x in (w, v):
        x.write(0b1010, 4)
    assert v.getvalue() == w.getvalue() and v.bit_len() == 18
    assert BitWriter.from_offset(b"abcdef", 2).getvalue() == b"ab"
