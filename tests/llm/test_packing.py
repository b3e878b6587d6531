import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from geodelta.llm import bins, common, packing

from .util import empty_docs, odd_docs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(plan, counts, cap):
    used = Counter()
    for filling, copies in plan:
        assert copies > 0 and sum(s * t for s, t in filling) <= cap
        for s, t in filling:
            used[s] += t * copies
    assert used == Counter(counts)
    return sum(n for _, n in plan)


def optimum(items, cap):
    """Exact, by trying every way to put the items in order into open bins."""
    items = sorted(items, reverse=True)
    best = len(items)

    def walk(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for k in {r: j for j, r in enumerate(room) if r >= items[i]}.values():
            walk(i + 1, [*room[:k], room[k] - items[i], *room[k + 1 :]])
        walk(i + 1, [*room, cap - items[i]])

    walk(0, [])
    return best


def test_bins_against_optimum():
    rng = random.Random(5)
    worse = 0
    for _ in range(150):
        items = [rng.randint(5, 60) for _ in range(rng.randint(1, 10))]
        counts = Counter(items)
        got = check(bins.pack(counts, 100), counts, 100)
        want = optimum(items, 100)
        assert bins.lower_bound(counts, 100) <= want <= got
        worse += got > want
    assert worse == 0


def test_branch_and_bound_beats_best_fit():
    counts = Counter([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])
    cap = 10
    best = check(bins.pack(counts, cap), counts, cap)
    assert best == 4
    hard = Counter([51, 27, 26, 23, 23, 23, 28, 27, 22] * 3)
    assert check(bins.pack(hard, 100), hard, 100) <= check(bins.best_fit_decreasing(hard, 100), hard, 100)


def test_bins_large_histogram():
    rng = random.Random(1)
    counts = Counter(min(1024, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(30000))
    got = check(bins.pack(counts, 1024), counts, 1024)
    assert got <= bins.lower_bound(counts, 1024) + 2
    with pytest.raises(ValueError):
        bins.pack({2000: 1}, 1024)
    assert bins.pack({}, 10) == []


def hugging(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing(spark):
    docs = odd_docs(spark, [(i, "word " * (i % 37) + "<|endoftext|>", "h", i) for i in range(100, 400)])
    got = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)
    rows = got.collect()
    want = Counter()
    given = docs.collect()
    for r, ids in zip(given, hugging([r["text"] for r in given])):
        first = len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(at)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by) == -(-total // 1024)
    seqs = packing.sequences(got).collect()
    assert len(seqs) == len(by) and all(len(s["ids"]) == 4 * s["n_tokens"] for s in seqs)


@pytest.mark.parametrize("text", [" " * 30_000, "\n" * 30_000 + "a", "b" + " \n\t" * 10_000 + " c", "x" + " " * 20_000 + "<|endoftext|>" + "\n" * 15_000 + "<|endoftext|>y", "a\u3000" + "\u3000" * 12_000 + "z", "a" + "\x1c" * 12_000 + " b", "é" + "\x85\xa0 " * 5_000 + "\n\nq"])
def test_long_runs_of_white_space(text):
    coder = packing.encoder(RANKS, public_tokenizers.PATTERN)
    assert [*packing.token_ids(coder, text, True), 2] == hugging([text])[0]


def test_ten_million_spaces():
    coder = packing.encoder(RANKS, public_tokenizers.PATTERN)
    for text in (" " * 10_000_000, "\n" * 10_000_000):
        table = coder._mergeable_ranks
        back = {v: k for k, v in table.items()}
        assert b"".join(back[i] for i in packing.token_ids(coder, text, True)) == text.encode()


def test_blocks_of_one_length(spark, monkeypatch):
    """Ranks over many blocks and parts of blocks; repeated rows; a bound that holds."""
    monkeypatch.setattr(packing, "BLOCK", 5)
    docs = spark.createDataFrame([(i % 300, "same words here") for i in range(400)] + [(i, "other") for i in range(30)], "doc_id long, text string")
    rows = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    used = len({s for s, _, _ in places})
    for (s, o, n), (t, p, _) in itertools.pairwise(places):
        assert (t == s and p == o + n) or (t > s and p == 0)
    assert len(rows) == 430 and {r["least_sequences"] for r in rows} <= {used, used - 1}


@pytest.mark.parametrize("group", [[], ["g"]])
def test_sum_before(spark, group):
    rng = random.Random(3)
    rows = [(g, k, rng.randint(1, 9)) for g in range(3 if group else 1) for k in rng.sample(range(100), 40)]
    got = common.sum_before(spark.createDataFrame(rows, "g int, k int, n long"), group, "k", "n", 7).collect()
    assert sorted((r["g"], r["k"], r["before"]) for r in got) == sorted((g, k, sum(n for h, j, n in rows if h == g and j < k)) for g, k, _ in rows)


def test_packing_empty(spark):
    assert packing.pack_documents(empty_docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_added_token_is_one_id(spark):
    """As tokenizers gives it with its defaults."""
    from tokenizers import Tokenizer

    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n\n c", "<|endoftext |>", "plain"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes() for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in packing.pieces(docs, RANKS, public_tokenizers.PATTERN, added=True).collect())
    assert got == list(enumerate(want))
