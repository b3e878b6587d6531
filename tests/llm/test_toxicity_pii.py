import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from geodelta.llm import pii, toxicity
from hypothesis import given, settings
from hypothesis import strategies as st

from .util import WORDS, empty_docs, odd_docs

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+%_ 0123456789()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_luhn_and_long():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("x" * 300000 + "@" * 1000 + "1" * 100000 + "." * 5) == []
    assert pii.base_spans("card 4111 1111-1111 1111!") == [(2, 5, 24)]


def test_spans(spark):
    token = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [(100 + i, f"word {token} more {i}", "", i) for i in range(30)] + [(200 + i, f"plain internationalisations{i}{'x' * 20} text", "", i) for i in range(30)]
    docs = odd_docs(spark, rows)
    got = {(r["doc_id"], r["spans"]): r for r in pii.spans(docs).collect()}
    for r in docs.collect():
        base = brute(r["text"] or "")
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        mine = next(v for (i, _), v in got.items() if i == r["doc_id"])
        assert mine["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert mine["spans"].split(",")[: len(shown)] == shown or not shown
        assert [mine[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[0] == k for b in base) for k in range(4)]
        if 100 <= r["doc_id"] < 200:
            assert mine["spans"] == "secret:14:54" and mine["n_added"] == 1
        if r["doc_id"] >= 200:
            assert mine["spans"] == ""
    assert pii.spans(empty_docs(spark)).count() == 0


def test_patterns_round_trip_and_em():
    text = 'the key: "0123456789abcdef0123456789abcdef"'
    code = pii.pattern_of(text, 10, 42)
    votes, features = pii.votes_of(code)
    assert votes == [1, 1, 1, 1, 1] and features == [1, 1, 0, 1]
    rng = random.Random(1)
    truth, counts = Counter(), Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = [int(y) if rng.random() < a else 1 - int(y) for a in (0.95, 0.9, 0.8, 0.7, 0.6)]
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[code * 16] += 1
        truth[code * 16] += y
    p = pii.expectation_maximisation(counts)
    right = sum(truth[c] if p[c] >= 0.5 else counts[c] - truth[c] for c in counts)
    assert right / 4000 > 0.93


def test_further_kinds(spark):
    """Keys with separators, account numbers and names are found among prose; prose with such signs is not."""
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return next(f"DE{k:02d}{body}" for k in range(100) if pii.iban_checks(f"DE{k:02d}{body}"))

    rows = []
    for i in range(60):
        whole = iban()
        shown = whole if i % 2 else " ".join(whole[k : k + 4] for k in range(0, 22, 4))
        secret = f"{key(3)}1{key(4)}-{key(3)}9{key(4)}_{key(3)}7{key(4)}"
        who = ["Dr. Weber", "Anna Schmidt", "Señora García", "James Miller-Jones"][i % 4]
        rows.append((i, f'sent by {who}, IBAN: {shown}; api_key="{secret}" and that is well-known/understood since 2019-2020'))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.spans(docs).collect():
        text = rows[r["doc_id"]][1]
        got = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in r["spans"].split(","))]
        assert [k for k, _ in got] == ["secret", "iban", "name"] and r["n_added"] == r["n_spans"] == 3
        assert got[0][1] == text.split('"')[1] and got[1][1] == text.split("IBAN: ")[1].split(";")[0] and got[2][1] == text[8 : text.index(",")]


def test_long_number_parts():
    """Parts of any number of digits: leading zeros do not count, other long parts fail."""
    zeros = "0" * 6000
    assert pii.base_spans(f"{zeros}1.2.3.4") == [(1, 0, 6007)]
    assert pii.base_spans(f"{'1' * 6000}.2.3.4 0.0.0.{zeros}") == [(1, 6007, 6013 + 6000)]


def test_redact(spark):
    docs = odd_docs(spark)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[9] == "Å ß été \U0001f600 mail <email> <phone>, <ip>" and texts[4] is None
    assert pii.mask("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a<email>f"


def toxic_rows(n, seed=3):
    rng = random.Random(seed)
    bad = ["scumword", "fooltalk", "vileterm"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        poor = rng.random() < 0.2
        ws = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        if toxic:
            ws += rng.sample(bad, 2)
        if poor:
            ws = [w + "###" for w in ws] + ["junkmark"]
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "c", i))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_chain_on_held_out(spark):
    rows, labels = toxic_rows(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string, quality int")
    known = spark.createDataFrame([x for x in labels if x[0] < 500] + [(1, None, 1), (10**6, 1, 1)], "doc_id long, quality long, toxic long")
    out = {r["doc_id"]: r for r in toxicity.score(docs, known).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if i >= 500]
    assert sum(out[i]["toxic"] == bool(truth[i]) for i in held) / len(held) > 0.98
    clean = toxicity.keep_clean(docs, known)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in out.items() if not r["toxic"]}


def test_chain_uses_earlier_categories():
    sets = [np.array([1, 2], np.uint64), np.array([3], np.uint64)] * 200
    y = np.array([[1.0, 1.0], [0.0, 0.0]] * 200)
    chain = toxicity.fit_chain(sets, y)
    assert chain[1].earlier.shape == (1,) and chain[1].earlier[0] > 0
    p = toxicity.chain_probabilities(chain, sets[:2])
    assert p[0, 1] > 0.9 and p[1, 1] < 0.1


def test_odd_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty_docs(spark), none).count() == 0
    out = toxicity.score(odd_docs(spark), none).collect()
    assert len(out) == 11 and not any(r["toxic"] for r in out)
    assert [len(s) for s in toxicity.word_sets(pa.array([None, "A, a. b!"]))] == [0, 2]


@pytest.mark.parametrize("text", ["", "no data here"])
def test_no_spans(text):
    assert pii.base_spans(text) == [] and list(pii.candidates(text, [])) == []
