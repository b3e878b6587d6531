"""The chunk codec on arrays: many chunks at a time, the same bytes and rows as ``codec``.

Encoding has no loop over rows: residuals are differences of shifted arrays, the last Doppler value of a slot comes from a stable sort, and the
only true recurrence (whether the last phase delta is remembered) is one of booleans, so it is settled by the last row that decides it alone and
the parity of the rows that turn it round since. All bit fields get their places by a running sum and go into 64-bit words at once.

Decoding walks all chunks of a batch in step, one row of each at a time. A chunk in which anything is amiss is left to ``codec``, which gives its
good rows and its error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import codec
from .schema import CN0_MAX, HEADER_LEN, SLOT_MAX, SLOT_MIN, SLOTS, CodecError

I64, U64 = np.int64, np.uint64


@dataclass
class Rows:
    """Columns of observations; ``held`` tells which rows have a phase."""

    ts: np.ndarray
    slot: np.ndarray
    cn0: np.ndarray
    pr: np.ndarray
    doppler: np.ndarray
    phase: np.ndarray
    held: np.ndarray

    def __getitem__(self, at) -> Rows:
        return Rows(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    def row(self, i: int) -> codec.Row:
        values = (int(getattr(self, f)[i]) for f in ("ts", "slot", "cn0", "pr", "doppler"))
        return (*values, int(self.phase[i]) if self.held[i] else None)


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(I64)
    return ((v << 1) ^ (v >> 63)).astype(U64)


def unzigzag(z: np.ndarray) -> np.ndarray:
    return (z >> U64(1)).astype(I64) ^ -(z & U64(1)).astype(I64)


def remembered(alone: np.ndarray, then: np.ndarray, first: np.ndarray) -> np.ndarray:
    """k[i] = then[i] if k[i - 1] else alone[i], and false in first rows; without a loop."""
    decided = first | (alone == then)
    turned = ~decided & alone
    at = np.arange(len(alone))
    last = np.maximum.accumulate(np.where(decided, at, 0))
    turns = np.cumsum(turned)
    return (alone & ~first)[last] ^ ((turns - turns[last]) & 1).astype(bool)


def last_of_lane(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of the last row with the same key, and whether there is one."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    old = np.zeros(len(key), I64)
    old[order[1:]] = values[order[:-1]]
    return old, same


def fields(rows: Rows, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and widths in bits of nine fields a row; none in a chunk's first row."""
    n = len(first)
    value, width = np.zeros((n, 9), U64), np.zeros((n, 9), I64)

    def delta(v: np.ndarray) -> np.ndarray:
        d = np.zeros(n, I64)
        d[1:] = v[1:] - v[:-1]
        d[first] = 0
        return d

    def put(k: int, cases: list[tuple[np.ndarray, np.ndarray | int, int]]) -> None:
        conditions = [c for c, _, _ in cases]
        value[:, k] = np.select(conditions, [np.asarray(v).astype(U64) if np.ndim(v) else np.full(n, v, U64) for _, v, _ in cases])
        width[:, k] = np.select(conditions, [w for _, _, w in cases])

    every = np.ones(n, bool)

    def dod(k: int, v: np.ndarray, near: int, far: int) -> None:
        d = delta(v)
        residual = delta(d)
        z = zigzag(residual)
        put(k, [
            (residual == 0, 0, 1),
            (z < U64(1 << near), U64(0b10 << near) | z, near + 2),
            (z < U64(1 << far), U64(0b110 << far) | z, far + 3),
            (every, 0b111, 3),
        ])
        put(k + 1, [((residual != 0) & (z >= U64(1 << far)), v.view(U64), 64), (every, 0, 0)])

    dod(0, rows.ts, 7, 9)
    moved = delta(rows.slot)
    put(2, [(moved == 0, 0, 1), (every, (rows.slot + 7 | 16).astype(U64), 5)])
    change = delta(rows.cn0)
    put(3, [(change == 0, 0, 1), (every, zigzag(change) | U64(1 << 9), 10)])
    dod(4, rows.pr, 10, 20)
    old, known = last_of_lane(np.cumsum(first) * 64 + rows.slot, rows.doppler)
    raw = (rows.doppler & 0xFFFFFFFF).astype(U64)
    z = zigzag(rows.doppler - old)
    put(6, [(~known, raw, 33), (z == 0, 0b10, 2), (z < U64(1 << 14), U64(0b110 << 14) | z, 17), (every, U64(0b111 << 32) | raw, 35)])
    # phase
    before = np.zeros(n, bool)
    before[1:] = rows.held[:-1] & ~first[1:]
    both = rows.held & before
    d = np.where(both, delta(rows.phase), 0)
    older = np.zeros(n, I64)
    older[1:] = d[:-1]
    small = lambda v: zigzag(v) < U64(1 << 32)
    kept = remembered(both & small(d), both & small(d - older), first)
    used = np.zeros(n, bool)
    used[1:] = kept[:-1] & ~first[1:]
    residual = np.where(used, d - older, d)
    z = zigzag(residual)
    put(7, [
        (~rows.held, before.astype(U64), 2),
        (~before, 0b10, 2),
        (residual == 0, 0b110, 3),
        (z < U64(1 << 32), U64(0b1110 << 32) | z, 36),
        (every, 0b1111, 4),
    ])
    put(8, [(rows.held & (~before | (z >= U64(1 << 32))), rows.phase.view(U64), 64), (every, 0, 0)])
    width[first] = 0
    return value, width


def pack(value: np.ndarray, width: np.ndarray, owner: np.ndarray, owners: int) -> list[bytes]:
    """The bit streams of all owners; fields come in order, each with its owner."""
    bits = np.bincount(owner, width, owners).astype(I64)
    words = -(-bits // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    ends = np.cumsum(width)
    begun = np.concatenate([[0], np.cumsum(bits)])[:-1]
    some = width > 0
    value, width, owner, place = value[some], width[some], owner[some], (ends - width)[some]
    place = place - begun[owner] + base[owner] * 64
    out = np.zeros(int(base[-1]) + 1, U64)
    if len(value):
        word, end = place >> 6, (place & 63) + width
        over = end > 64
        high = np.where(over, value >> np.where(over, end - 64, 0).astype(U64), value << np.where(over, 0, 64 - end).astype(U64))
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[starts]] = np.add.reduceat(high, starts)  # bits never overlap, so sums are unions
        out[word[over] + 1] += value[over] << (128 - end[over]).astype(U64)
    data = out.astype(">u8").tobytes()
    return [data[b * 8 : b * 8 + (n + 7) // 8] for b, n in zip(base.tolist(), bits.tolist())]


def encode(rows: Rows, starts: np.ndarray) -> tuple[list[bytes | None], list[CodecError | None]]:
    """A payload or an error for each chunk; ``starts``: where each chunk's rows start, and the number of rows at the end."""
    sizes = np.diff(starts)
    chunks = len(sizes)
    first = np.zeros(len(rows.ts), bool)
    first[starts[:-1]] = True
    errors: list[CodecError | None] = [None] * chunks
    owner = np.repeat(np.arange(chunks), sizes)
    bad_slot = (rows.slot < SLOT_MIN) | (rows.slot > SLOT_MAX)
    bad_cn0 = (rows.cn0 < 0) | (rows.cn0 > CN0_MAX)
    for i in np.flatnonzero(bad_slot | bad_cn0)[::-1].tolist():  # the first of a chunk stays
        errors[owner[i]] = CodecError("InvalidSlot", int(rows.slot[i])) if bad_slot[i] else CodecError("InvalidDbHz", int(rows.cn0[i]))
    value, width = fields(rows, first)
    streams = pack(value.ravel(), width.ravel(), np.repeat(owner, value.shape[1]), chunks)
    payloads: list[bytes | None] = [
        None if e else codec.header(n) + codec.verbatim(rows.row(at)) + s for e, n, at, s in zip(errors, sizes.tolist(), starts.tolist(), streams)
    ]
    return payloads, errors


class Bits:
    """Streams side by side in 64-bit words; reads up to 64 bits at a place of each."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], I64)
        words = sizes // 8 + 3  # a read past the end meets zeros; the caller looks at the place
        self.base = np.concatenate([[0], np.cumsum(words)[:-1]]) * 64
        data = bytearray(int(words.sum()) * 8)
        for s, at in zip(streams, (self.base // 8).tolist()):
            data[at : at + len(s)] = s
        self.words = np.frombuffer(bytes(data), ">u8").astype(U64)
        self.end = sizes * 8

    def window(self, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next 64 bits."""
        place = self.base[who] + np.minimum(at, self.end[who])
        word, bit = place >> 6, (place & 63).astype(U64)
        return self.words[word] << bit | self.words[word + 1] >> U64(1) >> (U64(63) - bit)


def _overflows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    return s, ((a ^ s) & (b ^ s)) < 0


def decode(payloads: list[bytes]) -> tuple[Rows, np.ndarray, np.ndarray]:
    """All rows of well-formed chunks, the chunk and number in it of each, in order. Chunks with an error give no row: see ``whole``."""
    ok, first_rows, streams, counts = [], [], [], []
    for k, data in enumerate(payloads):
        try:
            count = codec.read_header(data)
            if not count:
                continue
            row, used = codec._first(data[HEADER_LEN:])
        except CodecError:
            continue
        stream = data[HEADER_LEN + used :]
        if count - 1 <= len(stream):  # a row has eight bits at least
            ok.append(k)
            first_rows.append(row)
            streams.append(stream)
            counts.append(count)
    chunk_of, count = np.array(ok, I64), np.array(counts, I64)
    if not ok:
        empty = np.zeros(0, I64)
        return Rows(*[empty] * 6, np.zeros(0, bool)), empty, empty
    order = np.argsort(-count, kind="stable")  # chunks still open are the first ones
    chunk_of, count, first_rows = chunk_of[order], count[order], [first_rows[i] for i in order]
    bits = Bits([streams[i] for i in order])
    n = len(order)
    starts = np.concatenate([[0], np.cumsum(count)])
    out = Rows(*[np.zeros(int(starts[-1]), I64) for _ in range(6)], np.zeros(int(starts[-1]), bool))
    as_i64 = lambda c: np.array([codec.signed(r[c]) for r in first_rows], I64)
    ts, slot, cn0, pr, doppler = (as_i64(c) for c in range(5))
    held = np.array([r[5] is not None for r in first_rows])
    phase = np.array([r[5] or 0 for r in first_rows], I64)
    d_ts, d_pr, d_phase = np.zeros(n, I64), np.zeros(n, I64), np.zeros(n, I64)
    last, seen = np.zeros((n, SLOTS), I64), np.zeros((n, SLOTS), bool)
    every = np.arange(n)
    last[every, slot + 7], seen[every, slot + 7] = doppler, True
    at, bad = np.zeros(n, I64), np.zeros(n, bool)

    def keep(k: int, m: int) -> None:
        place = starts[:m] + k
        for name, column in (("ts", ts), ("slot", slot), ("cn0", cn0), ("pr", pr), ("doppler", doppler), ("phase", phase), ("held", held)):
            getattr(out, name)[place] = column[:m]

    def full(who: np.ndarray, skip: int) -> np.ndarray:
        return bits.window(who, at[who] + skip).view(I64)

    def second_order(x: np.ndarray, near: int, far: int, value: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A field's new values and its lengths, and where they overflow."""
        tag = x >> U64(61)
        short, long, whole = (tag >> U64(1)) == 2, tag == 6, tag == 7
        z = np.where(short, x >> U64(62 - near) & U64((1 << near) - 1), np.where(long, x >> U64(61 - far) & U64((1 << far) - 1), U64(0)))
        base, over_a = _overflows(value, step)
        new, over_b = _overflows(base, unzigzag(z))
        over = (over_a | over_b) & ~whole
        some = np.flatnonzero(whole)
        if len(some):
            new[some] = full(some, 3)
        return new, np.where(whole, 67, np.where(long, far + 3, np.where(short, near + 2, 1))), over

    keep(0, n)
    for k in range(1, int(count[0])):
        m = int(np.searchsorted(-count, -k))  # chunks with more than k rows
        who = every[:m]
        new_ts, used, _ = second_order(bits.window(who, at[:m]), 7, 9, ts[:m], d_ts[:m])
        at[:m] += used
        x = bits.window(who, at[:m])
        changed = x >> U64(63) == 1
        index = (x >> U64(59) & U64(15)).astype(I64)
        bad[:m] |= changed & (index >= SLOTS)
        new_slot = np.where(changed, np.minimum(index, SLOTS - 1) - 7, slot[:m])
        used = np.where(changed, 5, 1)
        x = x << used.astype(U64)  # nine of its bits are left at least
        changed = x >> U64(63) == 1
        new_cn0 = np.where(changed, cn0[:m] + unzigzag(x >> U64(54) & U64(511)), cn0[:m])
        bad[:m] |= (new_cn0 < 0) | (new_cn0 > CN0_MAX)
        at[:m] += used + np.where(changed, 10, 1)
        new_pr, used, over = second_order(bits.window(who, at[:m]), 10, 20, pr[:m], d_pr[:m])
        bad[:m] |= over
        at[:m] += used
        x = bits.window(who, at[:m])
        lane = new_slot + 7
        old, known = last[who, lane], seen[who, lane]
        tag = x >> U64(61)
        bad[:m] |= known & (tag < 4)
        absolute = ~known | (tag == 7)
        raw = np.where(known, x >> U64(29), x >> U64(31)).astype(np.uint32).view(np.int32).astype(I64)
        moved = np.where(tag == 6, old + unzigzag(x >> U64(47) & U64((1 << 14) - 1)), old)
        bad[:m] |= ~absolute & ((moved < -(1 << 31)) | (moved >= 1 << 31))
        new_doppler = np.where(absolute, raw, moved)
        at[:m] += np.where(~known, 33, np.where(tag == 7, 35, np.where(tag == 6, 17, 2)))
        x = bits.window(who, at[:m])
        tag = x >> U64(60)
        has, found = tag >= 8, (tag >> U64(2)) == 2
        bad[:m] |= has & ~found & ~held[:m]
        far = tag == 15
        z = np.where(tag == 14, x >> U64(28) & U64((1 << 32) - 1), U64(0))
        new_phase = phase[:m] + d_phase[:m] + unzigzag(z)
        for some, skip in ((np.flatnonzero(found), 2), (np.flatnonzero(far), 4)):
            if len(some):
                new_phase[some] = full(some, skip)
        at[:m] += np.where(~has, 2, np.where(found, 66, np.where(far, 68, np.where(tag == 14, 36, 3))))
        # what the next row's predictors need
        both = has & held[:m]
        delta = np.where(both, new_phase - phase[:m], 0)
        d_phase[:m] = np.where(both & (zigzag(delta - d_phase[:m]) < U64(1 << 32)), delta, 0)
        d_ts[:m], d_pr[:m] = new_ts - ts[:m], new_pr - pr[:m]
        ts[:m], slot[:m], cn0[:m], pr[:m], doppler[:m] = new_ts, new_slot, new_cn0, new_pr, new_doppler
        phase[:m], held[:m] = np.where(has, new_phase, 0), has
        last[who, lane], seen[who, lane] = new_doppler, True
        bad[:m] |= at[:m] > bits.end[:m]
        keep(k, m)
    by = np.argsort(chunk_of, kind="stable")
    by = by[~bad[by]]
    rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in by]) if len(by) else np.zeros(0, I64)
    numbers = np.concatenate([np.arange(count[i]) for i in by]) if len(by) else np.zeros(0, I64)
    return out[rows], np.repeat(chunk_of[by], count[by]), numbers


def whole(payload: bytes) -> tuple[list[codec.Row], CodecError | None]:
    """A chunk's good rows and its error, one by one."""
    rows: list[codec.Row] = []
    try:
        for row in codec.decode_iter(payload):
            rows.append(row)
    except CodecError as e:
        return rows, e
    return rows, None
