"""The pipeline's stages against brute force, on rows with nulls, repeated ids and near copies."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from geodelta.llm import pii
from tokenizers import Tokenizer

from .test_jaccard_rows import fast_brute
from .test_toxicity_pii import toxic_rows
from .util import WORDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node int, p_toxic string"


def rows_of(seed=2):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))
    texts = [prose(rng.choice([3, 20, 60, 120])) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t.replace(" ", "  \n", 1)) for i, t in enumerate(texts[:20])]  # equal after white space
    rows += [(200 + i, t + " tail" * (i % 3)) for i, t in enumerate(texts[:30])]  # near or equal
    rows += [(300 + i, texts[i] + " mail a.b@c.org or +1 (743) 555-3824") for i in range(40, 50)]
    rows += [(5, prose(40)), (5, texts[7]), (7, prose(40)), (None, texts[3]), (None, prose(30)), (None, None), (400, None), (401, ""), (402, " ")]
    rows += [(500, "same row " * 9)] * 3 + [(i, "hot copies of one text in many rows") for i in range(600, 640)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows], SCHEMA).repartition(5)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def exact(rows):
    """Of equal texts one row of the least id stays; which of several rows of one id does not matter but for its white space."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i))
    return Counter((min(g)[1], t) for t, g in groups.items())


def near(rows, got):
    """got holds one row of each component of linked texts, that of the least id, and all rows that take no part."""
    part = [(i, t) for i, t in rows if i is not None and (t or "").split()]
    out = [(i, t) for i, t in rows if not (i is not None and (t or "").split())]
    assert Counter(out) == Counter((i, t) for i, t in got if i is None or not (t or "").split())
    kept = [(i, t) for i, t in got if i is not None and (t or "").split()]
    roots = {}
    labels = fast_brute([(k, t) for k, (_, t) in enumerate(part)], 5, 80)
    for (i, t), (_, _, root) in zip(part, labels):
        roots.setdefault(root, []).append((i, t))
    assert len(kept) == len(roots)
    of = {x: root for root, members in roots.items() for x in members}
    assert sorted(of[x] for x in kept) == sorted(roots)
    assert all(x[0] == min(i for i, _ in roots[of[x]]) for x in kept)


def test_stages_on_copies(spark):
    rows = rows_of()
    docs = table(spark, rows)
    first = corpus_pipeline.drop_copies(spark, docs, "")
    assert first.columns == docs.columns
    got = pairs(first)
    assert Counter((i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in got) == exact(rows)
    second = corpus_pipeline.drop_near_copies(spark, table(spark, got), "")
    assert second.columns == docs.columns
    near(got, pairs(second))
    near(rows, pairs(corpus_pipeline.drop_near_copies(spark, docs, "")))  # on its own input, copies and all


def test_personal_data_stage(spark):
    rows = rows_of()
    docs = table(spark, rows)
    out = corpus_pipeline.mask_personal_data(spark, docs, "")
    assert out.columns == docs.columns
    want = Counter((i, t if not t else pii.mask(t, pii.base_spans(t))) for i, t in rows)  # the rows hold no other kinds
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_packing_stage(spark):
    rows = [(i, t) for i, t in rows_of() if i is not None]
    out = corpus_pipeline.pack(spark, table(spark, rows), "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(o == sum(n for p, n in spans if p < o) for spans in by.values() for o, _ in spans) and max(sum(n for _, n in s) for s in by.values()) <= 1024


def test_run_and_empty(spark, tmp_path):
    rows, labels = toxic_rows(400)
    clean = {i for i, _, toxic in labels if not toxic}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(out & clean) > 0.95 * len(clean) and len(out - clean) < 0.05 * len(rows)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_names(name):
    assert name in ("toxicity", "exact dedup", "near-duplicates", "personal data", "packing")
