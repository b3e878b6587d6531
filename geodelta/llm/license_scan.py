"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units are a document's lines, the whole document and all blocks of consecutive lines. Words are ASCII case folded and lose outer punctuation. A template is a candidate for a unit
only if their bigram counts allow the threshold: with threshold t, 2 min(a, b) / (a + b) >= t. Units that share no bigram with any template have a coefficient of 0;
so are documents that hold too few of a template's bigrams for any unit to reach the threshold. They are told apart for a whole batch at once, and
units are only compared for the few others. A block gains nothing from a first line without template bigrams, nor from lines after the last one found, so
blocks start and end accordingly; no other is left out. One pass, no shuffle.

Defined cases: null or empty text has no units and no licence; equal coefficients go to the template that comes first, then to
the first line (whole document after lines, then blocks by first line); a block is known by its first line, n_matched counts lines that match alone; repeated rows are treated alike; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W
from .common import blank, text_slices
from .toxicity import PUNCTUATION

THRESHOLD = 0.8
# Notices and short licence texts, by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "LGPL-3.0-only": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0-only": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Full texts, in ``licenses``. Those of GPL, AGPL and Creative Commons are not among them: they are so alike that each needs all its kin.
FULL = ["MIT", "Apache-2.0", "LGPL-3.0-only", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "Unlicense"]
for _name in FULL:
    TEMPLATES.setdefault(_name, []).append(pkgutil.get_data(__package__, f"licenses/{_name}.txt").decode())
SCHEMA = "doc_id long, n_lines long, n_matched long, license string, dice double, line_no long"


def unit_words(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all units and where each unit's start."""
    flat, offsets = W.split(units, lower=True)
    flat = pc.ascii_trim(flat, PUNCTUATION)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return W.codes(flat.filter(pa.array(real))), before[offsets]


def unit_bigrams(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bigram codes of all units and where each unit's start."""
    codes, offsets = unit_words(units)
    begin = W.starts(offsets, 2)
    runs = W.run_codes(codes, 2)[begin] if len(begin) else np.zeros(0, np.uint64)
    return runs, np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - 1, 0))])


def templates() -> list[tuple[str, frozenset]]:
    names = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    runs, offsets = unit_bigrams(pa.array([t for _, t in names]))
    return [(name, frozenset(runs[a:b].tolist())) for (name, _), a, b in zip(names, offsets, offsets[1:])]


def size_bounds(n: int, t: float = THRESHOLD) -> tuple[float, float]:
    """Least and largest set sizes that can reach the threshold with a set of n."""
    return n * t / (2 - t) - 1e-9, n * (2 - t) / t + 1e-9


def candidates(runs: np.ndarray, doc: np.ndarray, known: list[tuple[str, frozenset]], t: float = THRESHOLD) -> dict[int, list[tuple[int, int]]]:
    """By document the templates, with the number of their bigrams in it, that some unit may reach the threshold with."""
    vocabulary = np.unique(np.array([c for _, s in known for c in s], np.uint64))
    member = np.stack([np.isin(vocabulary, np.array(list(s), np.uint64)) for _, s in known], axis=1)
    slot = np.minimum(np.searchsorted(vocabulary, runs), len(vocabulary) - 1)
    hit = vocabulary[slot] == runs
    held = np.unique(doc[hit] * len(vocabulary) + slot[hit])
    docs, first = np.unique(held // len(vocabulary), return_index=True)
    if not len(docs):
        return {}
    shared = np.add.reduceat(member[held % len(vocabulary)], first, axis=0, dtype=np.uint32)
    least = np.array([max(1, size_bounds(len(s), t)[0]) for _, s in known])
    out: dict[int, list[tuple[int, int]]] = {}
    for i, k in zip(*np.nonzero(shared >= least)):
        out.setdefault(int(docs[i]), []).append((int(k), int(shared[i, k])))
    return out


def units_of(runs: np.ndarray, starts: np.ndarray, template: np.ndarray, held: int, t: float = THRESHOLD) -> Iterator[tuple[float, tuple[int, int, int]]]:
    """(dice, (kind, first line, line after)) of a document's units that reach the threshold; of the blocks that start in a line, only the best.

    Kinds are 0 for lines, 1 for the whole document, 2 for blocks. ``runs`` are the bigrams across lines, ``starts`` the lines' first words."""
    lines, size = len(starts) - 1, len(template)
    least, most = size_bounds(size, t)
    known = np.isin(runs, template)
    order = np.argsort(runs, kind="stable")
    before = np.full(len(runs), -1)
    same = runs[order[1:]] == runs[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    so_far = np.concatenate([[0], np.cumsum(known)])
    begins = np.minimum(starts[:-1], len(runs))
    ends = np.maximum(starts[1:] - 1, begins)
    for i in np.flatnonzero(so_far[ends] - so_far[begins] >= least):
        new = before[starts[i] : ends[i]] < starts[i]
        dice = 2 * int((new & known[starts[i] : ends[i]]).sum()) / (int(new.sum()) + size)
        if dice >= t:
            yield dice, (0, int(i), int(i) + 1)
    if lines == 1:
        return
    dice = 2 * held / (int((before < 0).sum()) + size)
    if dice >= t:
        yield dice, (1, 0, lines)
    last = np.minimum(starts[1:], len(runs))
    for i in np.flatnonzero(so_far[last] > so_far[begins]):
        s, width = int(starts[i]), int(2 * most)
        while True:  # until the block is too large, or holds all that the document holds of the template
            new = before[s : s + width] < s
            distinct, found = np.cumsum(new), np.cumsum(new & known[s : s + width])
            if s + width >= len(runs) or distinct[-1] > most or found[-1] >= held:
                break
            width *= 2
        if found[-1] < least:
            continue
        enough = s + int(np.searchsorted(found, found[-1])) + 2  # words up to the last new bigram of the template
        stop = min(lines, int(np.searchsorted(starts, enough)))
        after = np.arange(i + 1, stop + 1)
        count = np.minimum(starts[after] - 1 - s, len(new))
        after, count = after[count > 0], count[count > 0]
        if i == 0:
            after, count = after[after < lines], count[after < lines]
        after, count = after[after > i + 1], count[after > i + 1]
        if len(after):
            dices = 2 * found[count - 1] / (distinct[count - 1] + size)
            k = int(np.argmax(dices))
            if dices[k] >= t:
                yield float(dices[k]), (2, int(i), int(after[k]))


def scan(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_matched (lines), license, dice and line_no (a block's first; -1: the whole document) of the best match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates()
        codes_of = [np.array(list(s), np.uint64) for _, s in known]
        for batch in text_slices(batches, "text"):
            lists = pc.split_pattern(batch.column("text"), "\n")
            lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(lines)])
            codes, starts = unit_words(lists.flatten())
            runs, whole = W.run_codes(codes, 2), starts[edge]
            begin = W.starts(whole, 2)
            doc = np.repeat(np.arange(batch.num_rows), np.maximum(np.diff(whole) - 1, 0))
            best: dict[int, tuple[float, str, int]] = {}
            matched: dict[int, int] = {}
            for i, some in candidates(runs[begin], doc, known, t).items():
                a, b = whole[i], whole[i + 1]
                units = [
                    (-dice, unit, k)
                    for k, held in some
                    for dice, unit in units_of(runs[a : b - 1], starts[edge[i] : edge[i + 1] + 1] - a, codes_of[k], held, t)
                ]
                if units:
                    less, (kind, line, _), k = min(units)
                    best[i] = -less, known[k][0], -1 if kind == 1 else line
                    matched[i] = len({unit for _, unit, _ in units if unit[0] == 0})
            rows = [best.get(i, (None, None, None)) for i in range(batch.num_rows)]
            counts = [0 if blank_text else n for blank_text, n in zip(pc.equal(batch.column("text"), "").to_pylist(), lines.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array([matched.get(i, 0) for i in range(batch.num_rows)], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                ["doc_id", "n_lines", "n_matched", "license", "dice", "line_no"],
            )

    return docs.select("doc_id", blank("text").alias("text")).mapInArrow(run, SCHEMA)
