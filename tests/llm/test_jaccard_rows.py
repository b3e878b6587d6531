"""Random families of near copies against brute force, and rows that share ids."""

import random
from collections import Counter

from geodelta.llm import common, jaccard_join
from geodelta.llm.jaccard_join import jaccard_components, keep_one

from .util import empty_docs, odd_docs


def fast_brute(rows, size=4, percent=85):
    """Least linked id of each row, over all pairs that share a shingle; rows are nodes of their own."""
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        shared = Counter(j for sh in s for j in held.get(sh, ()))
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for sh in s:
            held.setdefault(sh, []).append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)]


def families(seed, count):
    rng = random.Random(seed)
    common_phrase = [f"c{k}" for k in range(12)]
    rows = []
    for g in range(count):
        length = rng.choice([6, 9, 14, 25, 40, 60, 90])
        base = [f"w{rng.randrange(400)}" for _ in range(length)] + (common_phrase if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 2, 4, 8, 16])):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(ws))
                ws[k : k + rng.randint(0, 1)] = [f"w{rng.randrange(400)}"] * rng.randint(0, 2)
            rows.append(" ".join(ws))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_random_families(spark):
    """Families of five seeds, which share no words."""
    rows = [(5 * i + seed, " ".join(f"{seed}{w}" for w in t.split())) for seed in range(5) for i, t in families(seed, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == sorted(fast_brute(rows))


def shared_id_rows():
    """Ids of several texts: near copies of others, of each other, and of nothing."""
    rng = random.Random(5)
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(k, text(k)) for k in range(12)] + [(k + 20, text(k) + " more") for k in range(12)]
    rows += [(5, text(100)), (5, text(101)), (5, text(2)), (2, text(100) + " x"), (40, text(3)), (40, text(4)), (0, text(200)), (0, text(200))]
    rows += [(6, text(6) + " y"), (7, ""), (7, None)]
    rng.shuffle(rows)
    return rows


def test_shared_ids(spark):
    rows = shared_id_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    want = [(doc, n, doc if n == 0 else c) for doc, n, c in fast_brute(rows)]
    assert got == sorted(want)


def test_keep_one(spark):
    rows = shared_id_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, node int, print_a string").repartition(3)
    kept = keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    brute = fast_brute(rows, 5, 80)
    groups = Counter((c, n) if n == 0 else c for _, n, c in brute)
    # one row of each component, with its least id; empty texts all stay
    full = [(d, t) for d, t in left if t]
    labels = {(d, t): c for (d, t), (_, n, c) in zip(rows, brute)}
    # different components may have the same least id, so count texts by brute-force root
    assert all(labels[x] == x[0] for x in full)
    roots = len({frozenset(j for j in range(len(rows)) if linked_to(rows, i, j)) for i in range(len(rows)) if rows[i][1]})
    assert len(full) == roots and len(left) - len(full) == 2 and groups


def linked_to(rows, i, j, size=5, percent=80):
    """Texts here are linked directly or not at all."""
    a, b = ({tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} for ws in ((rows[i][1] or "").split(), (rows[j][1] or "").split()))
    return i == j or bool(a) and 100 * len(a & b) >= percent * len(a | b)


def test_keep_one_odd_and_empty(spark):
    kept = sorted(r["doc_id"] for r in keep_one(odd_docs(spark)).collect())
    assert kept == [1, 4, 5, 6, 9, 10]
    assert keep_one(empty_docs(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert keep_one(nulls).count() == 3


def test_hot_keys_take_the_other_way(spark, monkeypatch):
    """With a bound of a few rows all heavy paths are used; results stay."""
    monkeypatch.setattr(common, "HEAVY", 1 << 40)
    monkeypatch.setattr(common, "LIGHT_ROWS", 2)
    monkeypatch.setattr(jaccard_join, "TASK_PAIRS", 4)
    rows = families(9, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == sorted(fast_brute(rows))
