import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from geodelta.llm import words as W
from geodelta.llm.substring_dedup import substring_dedup

from .util import WORDS, empty_docs


def brute(rows, size):
    seen, texts = Counter(), []
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        texts.append((i, ws))
        seen.update(tuple(ws[k : k + size]) for k in range(len(ws) - size + 1))
    out = []
    for i, ws in texts:
        gone = set()
        for k in range(len(ws) - size + 1):
            if seen[tuple(ws[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_words():
    flat, offsets = W.split(pa.array([" a\tb\x0b\x0c c ", None, "", "\x1c d e", "x"]))
    assert flat.to_pylist() == ["a", "b", "c", "\x1c", "d e", "x"] and offsets.tolist() == [0, 3, 3, 3, 5, 6]
    codes = W.codes(flat)
    many = [f"w{'x' * (i % 30)}{i}" for i in range(5000)] + ["y" * k for k in range(1, 700)]
    coded = W.codes(pa.array(["skip", *many])[1:])
    assert len(set(coded.tolist())) == len(many) and (W.codes(pa.array(many[::-1])) == coded[::-1]).all()
    assert W.run_codes(codes, 3)[0] == W.run_codes(np.concatenate([codes[:3], codes[:3]]), 3)[3]
    assert W.sliding_least(np.array([5, 1, 4, 1, 9, 2]), 3).tolist() == [1, 1, 3, 3]
    assert W.starts(np.array([0, 3, 3, 8]), 3).tolist() == [0, 3, 4, 5]
    assert len(W.starts(np.array([0]), 3)) == 0


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n)) for n in (34, 35, 36, 50, 80, 120)]
    rows = [(-1, None), (-2, ""), (-3, " \n"), (-4, "word " * 200), (-5, passages[3]), (-6, passages[3]), (-7, passages[5]), (-7, passages[5]), (None, passages[4]), (None, "x " + passages[2])]
    # ids of several texts, one of which repeats another's passage; and texts that keep all words
    rows += [(-9, "own " + passages[4] + " end"), (-9, " ".join(f"n{i}" for i in range(70))), (-9, passages[5] + " tail"), (-9, "own " + passages[4] + " end"), (3, passages[1]), (4, "")]
    rows += [(-10, "  lead\tand \x0b trail \n"), (-11, "\x1c a\u00a0b\u3000c"), (None, None), (None, " ".join(f"m{i}" for i in range(90)))]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            own = " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))
            cut = rng.choice(passages).split()
            a = rng.randint(0, 20)
            parts.append(rng.choice([own, rng.choice(passages), " \n ".join(cut[a : a + rng.randint(20, 60)])]))
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, code int, n int").repartition(5)
    for size in (35, 40):
        got = sorted(map(tuple, substring_dedup(docs, size, (9, 18) if size == 35 else (10, 20)).collect()), key=str)
        assert got == brute(rows, size)
    texts = {r["doc_id"]: r["kept_text"] for r in substring_dedup(docs, kept_text=True).collect()}
    assert texts[-5] == "" and texts[-3] == ""


def test_nothing_repeats(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(100))), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == brute(rows, 35)
    assert substring_dedup(empty_docs(spark)).count() == 0


def test_repeated_row_alone(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text)]
    assert sorted(map(tuple, substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows, 35)
