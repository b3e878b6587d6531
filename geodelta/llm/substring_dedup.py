"""Substring dedup by level-wise doubling.

A window of ``WINDOW`` (35) words is removed when its word sequence also starts anywhere else. Levels have 9, 18 and 35 words:
only windows that hold a repeated run of one length are extended to twice that length (the last level stops at the window),
until no candidates survive.

Level 9. Each window stands for its anchor, the run of 9 words with the least code among the 27 in it (leftmost). Equal windows
have equal anchors at equal distance, so a window whose anchor occurs once in the corpus cannot repeat. Neighbouring windows share anchors, so about one position in
14 is shuffled, not every one.
Level 18. Only windows with a repeated anchor go on. They choose an anchor again, now of 18 words.
Level 35. Only windows with a repeated 18-word anchor go on, as segments: the windows of an anchor that follow one another. A segment
that occurs twice is settled at once; the others are compared window by window, by the codes of anchor and window together.

Counts are added up before each shuffle; a code with a large share of all rows is joined back map-side (``heavy_join``).
No list of a code's places is ever collected. Texts are read again; only those of documents with survivors are shuffled
to meet their places (``split_by_keys``).

Defined cases: null or empty text has no words; texts shorter than a window keep all; repeated rows, ids included, repeat
each other's windows; a row without an id, or whose id another text has too, is known by a hash of id and text; an
empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut, heavy_join, remove, split_by_keys, text_slices

WINDOW = 35
LEVELS = (9, 18)


def _anchors(batch: pa.RecordBatch, level: int, window: int):
    """Of a batch: word codes' offsets, starts of windows, each window's anchor place, and runs' codes of the level."""
    flat, offsets = W.split(batch.column("text"))
    codes = W.codes(flat)
    begin = W.starts(offsets, window)
    runs = W.run_codes(codes, level)
    width = window - level + 1
    anchor = W.sliding_least(runs, width)[begin] if len(begin) else begin
    return codes, offsets, begin, anchor, runs


def _first_level(window: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            _, offsets, begin, anchor, runs = _anchors(batch, level, window)
            at = np.unique(anchor)
            doc = np.searchsorted(offsets, at, "right") - 1
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[at].view(np.int64)), pa.array(keys[doc]), pa.array((at - offsets[doc]).astype(np.int32))],
                ["code", "row_key", "at"],
            )

    return run


def _second_level(window: int, low: int, high: int):
    """Rows (code of the 18-word anchor, row_key, first window, codes of the windows that follow one another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            codes, offsets, begin, anchor, _ = _anchors(batch, low, window)
            lists = batch.column("places")
            sizes = np.diff(lists.offsets.to_numpy())
            alive = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], sizes)
            survive = np.zeros(len(codes) + 1, bool)
            survive[alive] = True
            at = begin[survive[anchor]]
            runs = W.run_codes(codes, high)
            upper = W.sliding_least(runs, window - high + 1)[at] if len(at) else at
            whole = W.run_codes(codes, window)
            # one row for windows that follow one another and share their anchor
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(upper) != 0)
            first = np.flatnonzero(new)
            doc = np.searchsorted(offsets, at[first], "right") - 1
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            ends = np.append(first, len(at)).astype(np.int32)
            windows = pa.ListArray.from_arrays(pa.array(ends), pa.array(whole[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(runs[upper[first]].view(np.int64)),
                    pa.array(keys[doc]),
                    pa.array((at[first] - offsets[doc]).astype(np.int32)),
                    windows,
                ],
                ["code", "row_key", "at", "windows"],
            )

    return run


def _last_level(window: int, kept_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            flat, offsets = W.split(batch.column("text"))
            lists = batch.column("places")
            sizes = np.diff(lists.offsets.to_numpy())
            places = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], sizes)
            edge = np.zeros(len(flat) + 1, np.int32)
            last = places + batch.column("sizes").flatten().to_numpy(zero_copy_only=False) + (window - 1)
            edge += np.bincount(places, minlength=len(edge)).astype(np.int32)
            edge -= np.bincount(last, minlength=len(edge)).astype(np.int32)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            kept = flat.filter(pa.array(~gone)).to_pylist()
            ends = offsets - removed[offsets]
            texts = [" ".join(kept[a:b]) for a, b in zip(ends, ends[1:])]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(np.diff(removed[offsets])),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
            ]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if kept_text:
                columns.append(pa.array(texts))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_windows(keyed: DataFrame, window: int = WINDOW, levels: tuple[int, int] = LEVELS) -> DataFrame:
    """(row_key, places, sizes): runs of starts (first, how many) of windows whose word sequence also starts elsewhere; written."""
    low, high = levels
    spark = keyed.sparkSession
    text = keyed.select("row_key", "text")
    none = spark.createDataFrame([], "row_key long, places array<int>, sizes array<int>")

    anchors = cut(text.mapInArrow(_first_level(window, low), "code long, row_key long, at int"), "anchors")
    total = anchors.count()
    groups = cut(anchors.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    alive = heavy_join(anchors, groups, ["code"], total)
    places = cut(alive.groupBy("row_key").agg(F.collect_list("at").alias("places")), "alive")
    remove(anchors)
    remove(groups)
    if places.limit(1).count() == 0:
        return none

    candidates, _ = split_by_keys(text, places, "row_key")
    schema = "code long, row_key long, at int, windows array<long>"
    longer = cut(
        candidates.join(places.hint("merge"), "row_key")
        .select("row_key", "text", "places")
        .mapInArrow(_second_level(window, low, high), schema)
        .withColumn("segment", F.xxhash64("windows"))
        .withColumn("size", F.size("windows")),
        "longer",
    )
    total = longer.count()
    # a whole segment (the windows of an anchor that follow one another) that occurs twice is settled as it is
    segments = cut(longer.groupBy("code", "segment").agg(F.count(F.lit(1)).alias("n")), "segments")
    twice = heavy_join(longer.select("code", "segment", "row_key", "at", "size"), segments.filter("n > 1"), ["code", "segment"], total)
    # a segment that occurs once is compared window by window with the anchor's other segments, each of them taken once
    several = cut(
        segments.groupBy("code").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("code"),
        "several",
    )
    taken, _ = split_by_keys(longer, several, "code")
    once = cut(
        taken.groupBy("code", "segment")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("row_key").alias("row_key"),
            F.min("at").alias("at"),
            F.min("windows").alias("windows"),
        )
        .select("code", "n", "row_key", "at", F.posexplode("windows").alias("k", "whole")),
        "windows",
    )
    total = once.count()
    shared = cut(once.groupBy("code", "whole").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    single = heavy_join(once.filter("n = 1"), shared, ["code", "whole"], total, "m")
    found = twice.select("row_key", "at", "size").unionByName(
        single.select("row_key", (F.col("at") + F.col("k")).alias("at"), F.lit(1).alias("size"))
    )
    out = cut(found.groupBy("row_key").agg(F.collect_list("at").alias("places"), F.collect_list("size").alias("sizes")), "places")
    for table in (places, longer, segments, several, once, shared):
        remove(table)
    return out


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, text: rows with equal ids and texts share a key, all others differ."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.xxhash64("doc_id", "text", F.lit(7))
    prints = text.select("doc_id", hashed.alias("print")).groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high"))
    # ids of several texts; null groups with null, so one null id alone needs no hash but its text
    shared = cut(prints.filter("low != high or doc_id is null").select("doc_id"), "shared")
    if not shared.limit(1).count():
        return text.withColumn("row_key", F.col("doc_id"))
    some, rest = split_by_keys(text, shared, "doc_id")
    marked = shared.withColumn("of_several", F.lit(True)).withColumnRenamed("doc_id", "shared_id").hint("merge")
    some = some.join(marked, some["doc_id"] == marked["shared_id"], "left")
    alone = F.col("doc_id").isNotNull() & F.col("of_several").isNull()
    return some.select("doc_id", "text", F.when(alone, F.col("doc_id")).otherwise(hashed).alias("row_key")).unionByName(
        rest.withColumn("row_key", F.col("doc_id"))
    )


def _whole(rows: DataFrame, kept_text: bool) -> DataFrame:
    """The result for texts that keep all their words, without Python."""
    joined = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    out = rows.select("doc_id", joined.alias("kept_text"))
    spaces = F.length("kept_text") - F.length(F.replace("kept_text", F.lit(" "), F.lit("")))
    n = F.when(F.col("kept_text") == "", F.lit(0)).otherwise(spaces + 1).cast("long")
    out = out.select("doc_id", n.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")
    return out if kept_text else out.drop("kept_text")


def substring_dedup(docs: DataFrame, window: int = WINDOW, levels: tuple[int, int] = LEVELS, kept_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; and kept_text if asked for."""
    keyed = keyed_rows(docs)
    places = repeated_windows(keyed, window, levels)
    maybe, with_none = split_by_keys(keyed, places, "row_key")
    some = maybe.join(places.hint("merge"), "row_key").select("doc_id", "text", "places", "sizes")
    others = maybe.join(places.select("row_key").hint("merge"), "row_key", "left_anti")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text
    out = some.mapInArrow(_last_level(window, kept_text), schema)
    return out.unionByName(_whole(others, kept_text)).unionByName(_whole(with_none, kept_text))
