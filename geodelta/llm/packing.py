"""Best-fit packing of token sequences by bin completion (see ``bins``).

Method. One pass tokenizes every whole text and writes its pieces. The driver reads their histogram of lengths (at
most 1024 numbers, whatever the corpus), packs it by bin completion branch-and-bound and gets fillings with copies. Each
piece then finds its place by its rank among the pieces of its length: ranks come from counts by (length, hash block)
and a row number within the block, so a length that holds a third of all pieces is spread over many tasks. The plan,
at most 1024 lengths with their runs of ranks, is broadcast; its size does not depend on the number of documents.

Defined cases: null or empty text is one piece of the end token alone; repeated rows and repeated ids are
pieces of their own; an empty table gives an empty result; extra columns are not carried. Texts of any length are
tokenized whole. The search's effort is bounded, so the number of sequences is near the least but not proven
least; ``least_sequences`` is a proven lower bound to hold it against.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bins
from .common import blank, cut, give_back_memory, sum_before, text_slices

CAPACITY = 1024
END_ID = 2
#: Pieces in a block of one length, about.
BLOCK = 1000

#: The vocabulary's added token; tokenizers gives it one id wherever it stands in a text.
ADDED = {"<|endoftext|>": 50256}
#: White space runs of this many characters are cut off before the pattern sees them, as its look-ahead gives up on runs of a million.
RUN = 10_000
# The characters of Unicode's White_Space, which the pattern calls \s.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_WHITE}]{{{RUN},}}")

_encoders: dict[tuple[str, str], object] = {}


def encoder(ranks_path: str, pattern: str):
    """The byte-level BPE of the public vocabulary, loaded once a task."""
    import tiktoken

    if (ranks_path, pattern) not in _encoders:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[ranks_path, pattern]


def token_ids(coder, text: str, added: bool) -> list[int]:
    """The ids of a whole text; ``added``: the added token's string is one id, as in the tokenizers library."""
    if len(text) < RUN or not _LONG_RUN.search(text):
        return coder.encode(text, allowed_special=set(ADDED), disallowed_special=()) if added else coder.encode_ordinary(text)
    ids: list[int] = []
    ((name, number),) = ADDED.items()
    for k, part in enumerate(text.split(name) if added else [text]):
        if k:
            ids.append(number)
        at = 0
        for m in _LONG_RUN.finditer(part):
            # the pattern takes the run but for the last character, which it leaves to the word behind; at the end, all of it
            end = m.end() if m.end() == len(part) else m.end() - 1
            ids += coder.encode_ordinary(part[at : m.start()])
            ids += coder._encode_single_piece(part[m.start() : end])
            at = end
        ids += coder.encode_ordinary(part[at:])
    return ids


def cut_points(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first may be shorter."""
    first = n % cap or cap
    return [(0, first), *((at, cap) for at in range(first, n, cap))]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, cap: int = CAPACITY, with_ids: bool = True, added: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids (binary, unsigned 32-bit) if asked for; ``added``: the added token's string is one id, as the tokenizers library gives it."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)
        for batch in text_slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*token_ids(coder, text, added), END_ID], "<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), cap)):
                    raw = ids[start : start + length].tobytes()
                    out.append((doc, k, start, length, zlib.crc32(raw), raw)[: 5 + with_ids])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names[: 5 + with_ids])
        _encoders.clear()  # an idle worker need not hold it

    return docs.select("doc_id", blank("text").alias("text")).mapInArrow(run, schema)


def runs_of(plan: bins.Plan) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By size, in order of rank: (first rank, last rank + 1, times in a bin, first bin, offset in the bin)."""
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bin_at = 0
    for filling, copies in plan:
        offset = 0
        for s, times in filling:
            at = used.get(s, 0)
            runs.setdefault(s, []).append((at, at + copies * times, times, bin_at, offset))
            used[s] = at + copies * times
            offset += s * times
        bin_at += copies
    return runs


def pack_pieces(cut_docs: DataFrame, cap: int = CAPACITY, nodes: int = bins.NODES) -> DataFrame:
    """The written pieces with sequence_id and offset, and least_sequences: a proven lower bound on the number of sequences."""
    spark = cut_docs.sparkSession
    counts = {int(r[0]): int(r[1]) for r in cut_docs.groupBy("length").count().collect()}  # at most cap rows
    runs = runs_of(bins.pack(counts, cap, nodes))
    give_back_memory()  # the search's, on the driver
    rows = [(s, -(-counts[s] // BLOCK), [list(run) for run in all_runs]) for s, all_runs in runs.items()]
    plan = spark.createDataFrame(rows, "size long, blocks long, runs array<struct<low:long,high:long,times:long,bin:long,at:long>>")
    # a length's pieces fall into blocks of about BLOCK, so neither a common length nor the whole table is one group
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))
    blocked = cut_docs.join(F.broadcast(plan.select("size", "blocks")), F.col("length") == F.col("size")).withColumn("block", block)
    sizes = cut(blocked.groupBy("length", "block").count(), "blocks")
    before = sum_before(sizes, ["length"], "block", "count").select("length", "block", "before")
    ranked = blocked.withColumn(
        "row", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32"))
    )
    rank = F.col("before") + F.col("row") - 1
    placed = (
        ranked.join(before, ["length", "block"])
        .withColumn("rank", rank)
        .join(F.broadcast(plan.select("size", "runs")), "size")
        .withColumn("run", F.expr("filter(runs, r -> rank >= r.low and rank < r.high)[0]"))
    )
    step = F.col("rank") - F.col("run.low")
    return placed.select(
        *cut_docs.columns,
        (F.col("run.bin") + F.floor(step / F.col("run.times"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + (step % F.col("run.times")) * F.col("length")).cast("long").alias("offset"),
        F.lit(bins.lower_bound(counts, cap) if counts else 0).cast("long").alias("least_sequences"),
    )


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, cap: int = CAPACITY, with_ids: bool = False, added: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``cap`` tokens; a row for each piece."""
    return pack_pieces(cut(pieces(docs, ranks_path, pattern, cap, with_ids, added), "pieces"), cap)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence: sequence_id, ids binary, n_tokens. Needs pieces with ids; a sequence has few."""
    return packed.groupBy("sequence_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), "").alias("h"),
        F.sum("length").alias("n_tokens"),
    ).select("sequence_id", F.unhex("h").alias("ids"), "n_tokens")
