import random
import re
import textwrap

import numpy as np
import pyarrow as pa
from geodelta.llm import license_scan, permutation_index
from geodelta.llm import words as W

from .util import empty_docs, odd_docs


def brute(text):
    def grams(unit):
        ws = [w.strip(license_scan.PUNCTUATION) for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in unit))]
        ws = [w for w in ws if w]
        return {tuple(ws[i : i + 2]) for i in range(len(ws) - 1)}

    best, matched = (0.0, None, None), 0
    lines = text.split("\n") if text else []
    units = list(enumerate(lines)) + ([(-1, text)] if len(lines) > 1 else [])
    for k, unit in units:
        a, top = grams(unit), (0.0, None)
        for name, texts in license_scan.TEMPLATES.items():
            for t in texts:
                b = grams(t)
                d = 2 * len(a & b) / max(1, len(a) + len(b))
                if d >= 0.8 and d > top[0]:
                    top = d, name
        if top[1] and k >= 0:
            matched += 1
        if top[0] > best[0]:
            best = *top, k
    return len(lines), matched, best[1], best[0] or None, best[2]


def test_license_scan(spark):
    texts = [
        "Some prose.\nReleased under the MIT License.\nmore", "licensed under the apache license version 2.0", "Licensed under the Apache License", "This work is licensed under the GNU\nGeneral Public License, version 3.",
        "Licensed under CC BY-NC 4.0!!", "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "\n", "the License", license_scan.TEMPLATES["MIT"][2] + " and more words here",
    ]
    docs = odd_docs(spark, [(100 + i, t, "c", i) for i, t in enumerate(texts)])
    out = sorted(map(tuple, license_scan.scan(docs).collect()))
    assert out == sorted((r["doc_id"], *brute(r["text"] or "")) for r in docs.collect())
    assert license_scan.scan(empty_docs(spark)).count() == 0


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def truth(ids, x, q, top):
    s = (x.astype(np.float64) * x[ids == q][0].astype(np.float64)).sum(1)
    order = [k for k in np.lexsort((ids, -s)) if ids[k] != q]
    return [(int(ids[k]), float(s[k])) for k in order[:top]]


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD", 1500)
    x = vectors(4000)
    x[100:160] = x[99]
    ids = np.arange(4000)
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, []), (5100, [1.0, 2.0])]
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in ids] + [(i, v, 1) for i, v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int").repartition(5)
    got = {}
    for r in permutation_index.search_every(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 4000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        want = dict(truth(ids, x, q, 20))
        hits += len(want.keys() & {v for _, v, _ in found})
        assert all(abs(want[v] - s) < 1e-12 for _, v, s in found if v in want)
    assert hits / (20 * len(got)) > 0.9
    assert [v for _, v, _ in got[120]] == [v for v, _ in truth(ids, x, 120, 20)]


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in permutation_index.search_every(few).collect()] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert permutation_index.search_every(few.limit(0)).count() == 0


def wrapped(text, width=60):
    return "\n".join(textwrap.wrap(text, width))


def test_license_blocks(spark):
    """Full texts and notices over several lines, inside longer documents."""
    prose = "\n".join(f"line {i} of some prose that goes on" for i in range(300))
    notice = license_scan.TEMPLATES["MIT"][2]
    full = {name: texts[-1] for name, texts in license_scan.TEMPLATES.items() if name in license_scan.FULL}
    texts = {100: ("MIT", 300), 101: ("MIT", 0), 102: ("BSD-3-Clause", 300), 103: ("MIT", 300)}
    rows = [
        (100, prose + "\n" + wrapped(notice) + "\n" + prose),
        (101, wrapped(notice) + "\n" + prose),
        (102, prose + "\n" + wrapped(full["BSD-3-Clause"], 78)),
        (103, prose + "\n" + wrapped(full["MIT"].split("\n", 2)[2], 78) + "\n" + prose),
        (104, prose),
    ]
    for name, text in full.items():
        rows.append((200 + len(rows), wrapped("Copyright (c) 2020 Some One\n" + text, 78)))
        texts[rows[-1][0]] = name, -1
    got = {r["doc_id"]: (r["license"], r["line_no"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(104) == (None, None)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in texts.items()}
    assert all(got[i] == texts[i] for i in (100, 101, 102, 103))


def test_block_search_is_whole():
    """Against all blocks, one by one."""
    rng = random.Random(4)
    for _ in range(300):
        lines = [[rng.randrange(6 + 20 * (rng.random() < 0.3)) for _ in range(rng.choice([0, 1, 2, 4]))] for _ in range(rng.randint(1, 9))]
        words = [w for line in lines for w in line]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        runs = np.array([a * 100 + b for a, b in zip(words, words[1:])], np.uint64)
        template = np.unique(runs[rng.randrange(max(1, len(runs))) :][: rng.randint(2, 8)])
        if not len(template):
            continue
        grams = lambda i, j: set(runs[starts[i] : max(starts[i], starts[j] - 1)].tolist())
        all_dice = {(i, j): 2 * len(grams(i, j) & set(template.tolist())) / (len(grams(i, j)) + len(template)) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)}
        held = len(set(runs.tolist()) & set(template.tolist()))
        got = list(license_scan.units_of(runs, starts, template, held)) if held >= license_scan.size_bounds(len(template))[0] else []
        assert max((d for d, _ in got), default=0) == max((d for d in all_dice.values() if d >= 0.8), default=0)
        assert all(all_dice[i, j] == d for d, (_, i, j) in got)
        assert {i for _, (kind, i, _) in got if kind == 0} == {i for (i, j), d in all_dice.items() if j == i + 1 and d >= 0.8}


def test_repeated_notice_is_whole(spark):
    """A wrapped notice many times over has few distinct bigrams, however long it is."""
    text = "\n".join(["Use of this source code is governed", "by a BSD-style license that can be", "found in the LICENSE file."] * 400)
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got[0][3] == "BSD-3-Clause" and got[0][1] == 1200
    distinct = text.split()
    codes, starts = license_scan.unit_words(pa.array(text.split("\n")))
    runs = W.run_codes(codes, 2)
    template = next(np.array(list(s), np.uint64) for n, s in license_scan.templates() if n == "BSD-3-Clause")
    held = len(np.intersect1d(runs, template))
    assert len(distinct) > 2000 and any(kind == 1 for _, (kind, _, _) in license_scan.units_of(runs, starts, template, held))


def test_queries_meet_their_shards_in_blocks(spark, monkeypatch):
    """No task holds more than about a shard and a block; a vector lies in one shard; a very common vector is dealt into parts."""
    monkeypatch.setattr(permutation_index, "SHARD", 100)
    monkeypatch.setattr(permutation_index, "BLOCK", 50)
    x = vectors(900)
    x[300:600] = x[300]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(900)], "vec_id long, embedding array<float>")
    search = permutation_index.search_shard

    def bounded(ids, vectors, order, q_ids, *rest):
        assert len(ids) <= 150 and len(q_ids) <= 110, (len(ids), len(q_ids))
        return search(ids, vectors, order, q_ids, *rest)

    monkeypatch.setattr(permutation_index, "search_shard", bounded)
    got = {}
    for r in permutation_index.nearest(df, df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert len(got) == 900 and all(len(g) == 20 == len({v for _, v in g}) for g in got.values())
    hits = [len({v for _, v in got[q]} & {v for v, _ in truth(np.arange(900), x, q, 20)}) for q in range(0, 900, 9) if not 300 <= q < 600]
    assert np.mean(hits) / 20 > 0.9


def test_original_vectors_are_measured(spark):
    """Doubles stay doubles, great and small ones included, and norms may differ widely."""
    rows = [(0, [0.1, 0.7]), (1, [0.3, 0.2]), (2, [1e39, 1.0]), (3, [1e-50, 1e-50]), (4, [-1.0, 1e300]), (5, [1.0, 2.0, 3.0]), (7, [3.0, 2.0, 1.0]), (9, [0.3, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in permutation_index.nearest(df, df).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    same = [(i, v) for i, v in rows if len(v) == 2]
    for q, v in same:
        want = sorted(((i, sum(a * b for a, b in zip(v, w))) for i, w in same if i != q), key=lambda x: (-x[1], x[0]))
        assert got[q] == want
    assert got[5] == [(7, 10.0)] and got[7] == [(5, 10.0)]


def test_norms_of_all_sizes(spark):
    """Largest inner product, not least angle: the long vectors win."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) * np.exp(rng.normal(size=(3000, 1)))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(3000)], "vec_id long, embedding array<double>")
    hits = []
    got = {}
    for r in permutation_index.search_every(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in got:
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())))
    assert np.mean(hits) / 20 > 0.9


def test_shards_are_bounded():
    rng = np.random.default_rng(2)
    pivots = rng.normal(size=(64, 5))
    counts = rng.integers(0, 50, 64)
    counts[7] = 1000
    first, parts = permutation_index.shards_of(pivots, counts, 100)
    held = {}
    for s, p, c in zip(first.tolist(), parts.tolist(), counts.tolist()):
        held.setdefault(s, []).append(c / p)
    assert max(map(sum, held.values())) <= 100 and parts[7] == 10
    used = sorted(s + j for s, p in {(s, p) for s, p in zip(first.tolist(), parts.tolist())} for j in range(p))
    assert used == list(range(len(used)))
