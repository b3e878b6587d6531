"""Words of whole texts as 64-bit codes, and codes of runs of words, a batch at a time.

A word is ``[^\\x20\\x09-\\x0D]+``. A word's code mixes its UTF-8 bytes; a run's code is built by doubling
from the codes of its halves, so runs of 35 words need six vector operations, not 35.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of pairs, in order."""
    return mix(a * _A + mix(b ^ _B))


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a text array, null as empty, and where each text's words start (one more at the end)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=offsets[1:])
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        before = np.concatenate([[0], np.cumsum(real)])
        flat = flat.filter(pa.array(real))
        offsets = before[offsets]
    return flat, offsets


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 512


def codes(words: pa.Array) -> np.ndarray:
    """A 64-bit code for each word, from its length and its bytes, eight at a time for all words at once."""
    count = len(words)
    if not count:
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + count + 1].astype(np.int64)
    padded = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    padded[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    start, length = ends[:-1] - ends[0], np.diff(ends)
    out = mix(length.astype(np.uint64) * _A)
    left = np.flatnonzero(length <= _LONG)
    at = 0
    while len(left):
        block = eights[start[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]
        out[left] = mix((out[left] ^ block) * _B + _A)
        at += 8
        left = left[length[left] > at]
    for k in np.flatnonzero(length > _LONG):
        from xxhash import xxh64_intdigest

        out[k] = xxh64_intdigest(padded[start[k] : start[k] + length[k]].tobytes())
    return out


def run_codes(words: np.ndarray, length: int) -> np.ndarray:
    """The code of the run of ``length`` words that starts at each word; only those that lie in one text mean anything."""
    if length == 1:
        return words
    half = -(-length // 2)
    part = run_codes(words, half)
    shift = length - half
    if len(part) <= shift:
        return np.zeros(0, np.uint64)
    return join(part[:-shift], part[shift:])


def starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a run of ``length`` words lies in one text."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return first + np.arange(count.sum())


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each position the index of the leftmost least value among the next ``width``."""
    at = np.arange(len(values))
    have = 1
    best = at
    while have < width:
        shift = min(have, width - have)
        left, right = best[:-shift], best[shift:]
        best = np.where(values[right] < values[left], right, left)
        have += shift
    return best
