import random
import re

import numpy as np
import pyarrow as pa
import pytest
from geodelta.llm import jaccard_join
from geodelta.llm.components import components
from geodelta.llm.jaccard_join import boundary, jaccard_components, light_cost, needed, partner_sizes

from .util import WORDS, empty_docs, odd_docs


def brute(rows, size=4, percent=85):
    sets = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def variants(rng):
    rows = [(-1, None), (-2, ""), (-3, " \n "), (-4, "One two"), (-5, "one TWO"), (-6, "one two three four"), (-7, "Éa b"), (-8, "éa b")]
    line = "released under the common line of all documents in this set "
    for g in range(18):
        base = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.choice([9, 10, 12, 15, 16, 20, 24, 28, 60, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            ws = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(ws))
                ws[k : k + rng.randint(0, 1)] = [rng.choice(WORDS).upper()] * rng.randint(0, 2)
            rows.append((len(rows), " ".join(ws) + (" " + line if rng.random() < 0.3 else "")))
    for k in range(20):
        rows.append((len(rows), line + WORDS[k]))
    return rows


@pytest.mark.parametrize("rounds,percent", [(6, 85), (1, 80)])
def test_against_brute_force(spark, monkeypatch, rounds, percent):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    rng = random.Random(rounds)
    rows = variants(rng)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, code int, n int").repartition(6)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, 4, percent).collect())
    assert got == brute(rows, 4, percent)


def test_light_alone_finds_all(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(9, 15))]
        for _ in range(5):
            ws = list(base)
            ws[rng.choice([0, -1])] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(ws[: rng.randint(len(ws) - 1, len(ws))])))
    docs = spark.createDataFrame(rows, "node long, text string")
    links = jaccard_join.light_links(jaccard_join.entries(docs, 4, 85, 12, np.zeros(1 << 20, np.uint8)))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = {i: c for i, _, c in brute(rows)}
    sets = {i: frozenset(zip(*[t.split()[k:] for k in range(4)])) for i, t in rows}
    # equal sets are one class before the light join, so compare what differs
    for i, c in want.items():
        if any(want[j] == c and sets[j] != sets[i] for j in want):
            assert got.get(i) is not None


def test_cost_boundary():
    assert needed(6, 7, 85) == 6 and partner_sizes(3, 20, 85) == [] and light_cost(6, 12, 85) == 1
    assert 5 < boundary({n: 100 for n in range(1, 40)}, 85) <= jaccard_join.LIGHT_MOST


def test_odd_and_empty(spark):
    out = {r["doc_id"]: r for r in jaccard_components(odd_docs(spark)).collect()}
    assert out[8]["component_id"] == 6 and out[7]["component_id"] == 6 and out[2]["component_id"] == 1
    assert out[4]["n_shingles"] == 0 and out[4]["component_id"] == 4
    assert jaccard_components(empty_docs(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[300] == 100 and got[200] == 100


@pytest.mark.parametrize("seed", [1, 2])
def test_near_threshold_pairs_of_shared_phrases(spark, seed):
    """Pairs that just link, of phrases that many documents hold, so that lists differ in their largest component."""
    rng = random.Random(seed)
    phrases = [[f"p{k}w{i}" for i in range(10)] for k in range(10)]
    rows = []
    for g in range(90):
        words = [w for k in rng.sample(range(10), 6) for w in phrases[k]][: rng.choice([53, 54, 55, 57])]
        at = rng.randrange(4, len(words) - 4)
        rows += [words, [*words[:at], f"new{g}", *words[at + 1 :]]]
    rng.shuffle(rows)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("size", [4, 5])
def test_short_texts_differ(size):
    texts = ["a b c", "a b b c", "a b", "a b b", "a", "a a", "a a a", "a a a a"]
    assert len({tuple(s.tolist()) for s in jaccard_join.shingle_sets(pa.array(texts), size)}) == len(texts)
