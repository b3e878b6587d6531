"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A text is escaped (a leading and all other spaces become the space sign) and cut before each run of space signs; no piece of such a
model reaches over that boundary (checked when it is loaded). Of a batch, the segments not seen before in the task are concatenated; the
array of their suffixes is sorted, and every piece of the vocabulary is found in it by binary search, as a range of occurrences.
Occurrences are edges between places, sorted by position. Relaxing a segment's edges follows the model's rule: of the edges that join
two neighbouring parts the one with the best score (leftmost on ties) is taken, until none is left; all short segments are relaxed at
once, a step of each in a round. Characters outside the vocabulary become their bytes. Decoding is the inverse, by a table of the pieces' bytes.

A segment of more than ``PART`` characters is matched part by part and cut wherever no edge crosses, as no merge does either; so only a stretch that
pieces cover without any gap (one letter many times over) is relaxed as a whole, by a heap of numbers that takes some 80 bytes a character.

Results equal the public library's for models with the identity normaliser. Memory is bounded by the batch, that stretch and the task's table of segments
(``KNOWN`` at most; when full it starts anew). One pass, no shuffle. ``encode`` and ``decode`` work on DataFrames.

Defined cases: null or empty text has no ids; the space sign itself in a text decodes to a space; repeated rows are treated alike; an empty
table gives an empty result; extra columns are not carried by ``round_trip``, all are by ``encode`` and ``decode``. Whole texts are encoded, of any length. In
``decode`` null ids give null text, ids outside the vocabulary an error.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank, free_name, text_slices

SPACE = "▁"
END = "\U0010ffff"
KNOWN = 400_000
#: Characters of new segments matched at a time, and the size from which a segment is relaxed alone.
PART, LONG = 1 << 18, 64
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SCHEMA = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean"


class Codec:
    """A model's pieces, and the segments encoded so far."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece reaches over a space")
        # the last entry stands for no piece
        self.scores = np.full(n + 1, -np.inf)
        self.scores[plain] = [model.get_score(i) for i in plain]
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.table = [b""] * n
        for p, i in self.pieces.items():
            self.table[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.table[i] = bytes([b])
        self.names = np.array(sorted(self.pieces))
        self.ids = np.array([self.pieces[p] for p in self.names.tolist()])
        self.width = max(map(len, self.pieces))
        self.after = np.array([(p + END * self.width)[: self.width + 1] for p in self.names.tolist()])
        self.sizes = np.char.str_len(self.names)
        self.known: dict[str, list[int]] = {}
        # the place of each id among all scores, best first
        self.place = np.unique(-self.scores, return_inverse=True)[1].tolist()

    def edges(self, segments: list[str]) -> np.ndarray:
        """at[start, size] is the id of the piece that occurs there in the joined segments, -1 where none does."""
        text = END.join(segments) + END * self.width
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(points) - self.width
        windows = np.lib.stride_tricks.sliding_window_view(points, self.width)[:n]
        # suffixes by their first ``width`` characters, sorted by doubling ranks
        rank = np.unique(points, return_inverse=True)[1].astype(np.int64)
        length = 1
        while length < self.width:
            step = min(length, self.width - length)
            ahead = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            length += step
        order = np.argsort(rank[:n], kind="stable")
        suffixes = np.ascontiguousarray(windows[order]).view(f"<U{self.width}").reshape(-1)
        low = np.searchsorted(suffixes, self.names, "left")
        high = np.searchsorted(suffixes, self.after, "right")
        # a piece's range holds the suffixes that start with it; its end is found with the largest character after it
        count = np.maximum(high - low, 0)
        first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        start = order[first + np.arange(count.sum())]
        # sorting by position: each edge goes to the row of its start
        at = np.full((n, self.width + 1), -1, np.int32)
        at[start, np.repeat(self.sizes, count)] = np.repeat(self.ids, count)
        return at

    def offers(self, at: np.ndarray, left: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The scores of the edges from the starts left to the ends after; no edge is minus infinity."""
        size = after - left
        fits = (size > 0) & (size <= self.width)
        return np.where(fits, self.scores[at[left, np.where(fits, size, 0)]], -np.inf)

    def relax_many(self, at: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the parts of all segments, by position. In a round each segment's best edge, leftmost on ties, joins two parts."""
        owner = np.repeat(np.arange(len(base)), size)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + base[owner]
        stop = base + size
        done = []
        while len(start):
            # a part's end is the next part's start, or the segment's end
            last = np.append(owner[1:] != owner[:-1], True)
            end = np.where(last, stop[owner], np.append(start[1:], 0))
            offer = np.where(last, -np.inf, self.offers(at, start, np.append(end[1:], 0)))
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(begins, len(owner)))
            best = np.maximum.reduceat(offer, begins)
            open_ = np.repeat(best > -np.inf, lengths)
            done.append((start[~open_], end[~open_]))
            hit = np.flatnonzero((offer == np.repeat(best, lengths)) & open_)
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
            keep = open_
            keep[hit + 1] = False
            start, owner = start[keep], owner[keep]
        start, end = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, int), np.zeros(0, int))
        by = np.argsort(start, kind="stable")
        return start[by], end[by]

    def relax_long(self, at: np.ndarray, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``relax_many`` for one long segment, by a heap of edges."""
        rows, sizes = np.nonzero(at[base : base + size] >= 0)
        score = dict(zip(zip(rows.tolist(), (rows + sizes).tolist()), self.scores[at[base + rows, sizes]].tolist()))
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        end = list(range(1, size + 1))
        alive = [True] * size
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (i, end[j]) in score:
                heapq.heappush(heap, (-score[i, end[j]], i, j, end[j]))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and after[i] == j and j < size and alive[j] and end[j] == stop):
                continue
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[i] < size:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        start = base + np.flatnonzero(alive)
        return start, np.append(start[1:], base + size)

    def gaps(self, segment: str) -> Iterator[int]:
        """Places of a long segment that no edge of two characters or more crosses."""
        reach = 0
        for at in range(0, len(segment), PART):
            block = segment[at : at + PART + self.width]
            edges = self.edges([block])[: min(PART, len(segment) - at)]
            sizes = np.where(edges >= 0, np.arange(self.width + 1), 0).max(axis=1)
            places = np.arange(at, at + len(edges))
            # how far the edges that start before a place go
            far = np.maximum.accumulate(np.concatenate([[reach], places + np.maximum(sizes, 1)]))
            yield from places[far[:-1] <= places].tolist()
            reach = int(far[-1])

    def encode_long(self, segment: str) -> np.ndarray:
        """A segment of more than PART characters, cut at its gaps."""
        out: list[np.ndarray] = []
        some: list[str] = []
        held = start = 0
        for end in (*self.gaps(segment), len(segment)):
            if end == start:
                continue
            part, start = segment[start:end], end
            if len(part) > PART:
                out += [self.flat(some), self.stretch(part)]
                some, held = [], 0
                continue
            some.append(part)
            held += len(part)
            if held >= PART:
                out.append(self.flat(some))
                some, held = [], 0
        return np.concatenate([*out, self.flat(some)])

    def flat(self, segments: list[str]) -> np.ndarray:
        """The ids of segments of at most PART characters, one after another."""
        new = {s for s in segments if s not in self.known}
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, set(segments)
        self.learn(sorted(new))
        return np.array([i for s in segments for i in self.known[s]], np.int32)

    def stretch(self, text: str) -> np.ndarray:
        """A long stretch without gaps, as a whole: a heap of (score's place, start, size) as one number each."""
        n, pieces, place = len(text), self.pieces, self.place
        after, before, end = (array("i", range(k, n + k)) for k in (1, -1, 1))
        alive = bytearray(b"\1") * n

        def edge(i: int, stop: int) -> int | None:
            piece = pieces.get(text[i:stop]) if stop - i <= self.width else None
            return None if piece is None else (place[piece] << 40 | i) << 8 | (stop - i)

        heap = [e for e in (edge(i, i + 2) for i in range(n - 1)) if e is not None]
        heapq.heapify(heap)
        while heap:
            e = heapq.heappop(heap)
            i, stop = e >> 8 & 0xFFFFFFFFFF, (e >> 8 & 0xFFFFFFFFFF) + (e & 0xFF)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop or end[i] != j:
                continue
            alive[j] = 0
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                e = edge(i, end[after[i]])
                if e is not None:
                    heapq.heappush(heap, e)
            if before[i] >= 0:
                e = edge(before[i], stop)
                if e is not None:
                    heapq.heappush(heap, e)
        ids: list[int] = []
        i = 0
        while i < n:
            piece = pieces.get(text[i : end[i]])
            ids += [piece] if piece is not None else [self.byte_ids[b] for b in text[i : end[i]].encode("utf-8", "replace")]
            i = after[i]
        return np.array(ids, np.int32)

    def learn(self, segments: list[str]) -> None:
        """Encode new segments, some at a time, and keep them."""
        total = np.cumsum([len(s) for s in segments]) // PART
        edge = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(segments)]
        for a, b in zip(edge, edge[1:]):
            if b > a:
                self.learn_some(segments[a:b])

    def learn_some(self, segments: list[str]) -> None:
        at = self.edges(segments)
        size = np.array([len(s) for s in segments])
        base = np.cumsum(size + 1) - size - 1
        short = size <= LONG
        parts = [self.relax_many(at, base[short], size[short])]
        parts += [self.relax_long(at, int(base[k]), int(size[k])) for k in np.flatnonzero(~short)]
        start, end = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(start, kind="stable")
        start, end = start[by], end[by]
        # a part that is no edge is a single character outside the vocabulary, as its bytes
        span = end - start
        ids = np.where(span <= self.width, at[start, np.minimum(span, self.width)], -1)
        owner = np.searchsorted(base, start, "right") - 1
        unknown = {}
        for k in np.flatnonzero(ids < 0).tolist():
            o = owner[k]
            text = segments[o][start[k] - base[o] : end[k] - base[o]]
            unknown[k] = [self.byte_ids[b] for b in text.encode("utf-8", "replace")]
        edge = np.searchsorted(owner, np.arange(len(segments) + 1)).tolist()
        mixed = set(owner[list(unknown)].tolist())
        flat = ids.tolist()
        for k, s in enumerate(segments):
            a, b = edge[k], edge[k + 1]
            self.known[s] = [i for j in range(a, b) for i in unknown.get(j, flat[j : j + 1])] if k in mixed else flat[a:b]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        short = sorted({s for segments in cut for s in segments if len(s) <= PART})
        self.flat(short)
        out = []
        for segments in cut:
            if all(len(s) <= PART for s in segments):
                out.append(np.array([i for s in segments for i in self.known[s]], np.int32))
            else:
                out.append(np.concatenate([self.flat([s]) if len(s) <= PART else self.encode_long(s) for s in segments]))
                self.flat(short)  # long segments may have filled the table anew
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        text = b"".join([self.table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_crc32 (UTF-8), same (decoded text is the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in text_slices(batches, "text"):
            rows = []
            texts = batch.column("text").to_pylist()
            for doc, text, ids in zip(batch.column("doc_id").to_pylist(), texts, codec.encode(texts)):
                back = codec.decode(ids)
                rows.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", blank("text").alias("text")).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the text's ids as array<int> after all other columns; an equal name is replaced."""
    kept = docs.drop(ids)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    filled = free_name(kept, "filled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in text_slices(batches, filled):
            found = codec.encode(batch.column(filled).to_pylist())
            edges = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], schema.names)

    return kept.withColumn(filled, blank(F.col(f"`{text}`"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their ids after all other columns; an equal name is replaced."""
    kept = encoded.drop(text)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)
