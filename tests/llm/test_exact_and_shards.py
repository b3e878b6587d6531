import hashlib
import re
import zlib
from collections import defaultdict

from geodelta.llm import common
from geodelta.llm import exact_dedup as exact_dedup_module
from geodelta.llm.exact_dedup import exact_dedup, keep_first
from geodelta.llm.sharding import shard_rows, two_pass_shuffle, write_shards

from .util import empty_docs, odd_docs


def brute(rows):
    """Of equal texts one row stays: of the least id, and of rows with that id one."""
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    return sorted(
        (i, min(g), len(g), k == 0, hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k, i in enumerate(sorted(g))
    )


def test_exact_dedup(spark):
    docs = odd_docs(spark, [(i, "hot line", "h", i) for i in range(100, 140)])
    assert sorted(map(tuple, exact_dedup(docs).collect())) == brute(docs.collect())


def test_exact_dedup_empty_and_null_ids(spark):
    assert exact_dedup(empty_docs(spark)).count() == 0
    rows = exact_dedup(spark.createDataFrame([(None, "a"), (5, "a")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["keep_id"], r["kept"]) for r in rows) == [(False, 5, True), (True, 5, False)]


def test_keep_first_loses_no_unique_text(spark):
    rows = [(1, "a"), (2, "a"), (2, "unique"), (None, "a"), (None, "alone"), (None, "alone"), (3, "twice"), (3, "twice"), (4, None), (5, ""), (1, "other")]
    docs = spark.createDataFrame([(i, t, {"k": 1}, "x") for i, t in rows], "doc_id long, text string, _digest map<string,int>, digest string")
    left = [(r["doc_id"], r["text"]) for r in keep_first(docs.repartition(5)).collect()]
    want = [(1, "a"), (2, "unique"), (None, "alone"), (3, "twice"), (4, None), (1, "other")]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_exact_dedup_large_groups_below_the_proposals(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "CANDIDATES", 1)
    monkeypatch.setattr(common, "HEAVY", 1 << 40)
    monkeypatch.setattr(common, "LIGHT_ROWS", 2)
    docs = spark.createDataFrame([(i, f"text {i % 7 if i < 200 else i}") for i in range(260)], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup(docs).collect())) == brute(docs.collect())


def test_keep_first_keeps_columns(spark):
    docs = odd_docs(spark)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 6, 8, 9, 10}


def test_sharding(spark):
    docs = odd_docs(spark, [(i, "hot line", "h", i) for i in range(100, 400)])
    out = shard_rows(docs).collect()
    assert len(out) == docs.count()
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(shards) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_sharding_of_rows_without_ids(spark, monkeypatch):
    """Equal and missing ids spread over the buckets; columns of any type travel along."""
    from geodelta.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sharding, "REDUCERS", 3)
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "'same' text", "map('a', id) m", "1 bucket", "2 at").repartition(5)
    out = two_pass_shuffle(docs).selectExpr("record.*", "shard", "slot").collect()
    assert sorted(r["m"]["a"] for r in out) == list(range(3000))
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(24) for k in range(125)]
    order = [r["m"]["a"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert 1300 < sum(a < b for a, b in zip(order, order[1:])) < 1700


def test_sharding_is_a_shuffle(spark):
    docs = spark.range(2000).selectExpr("id doc_id", "cast(id as string) text", "1 shard", "2 slot")
    out = two_pass_shuffle(docs).orderBy("shard", "slot").selectExpr("record.doc_id").collect()
    order = [r[0] for r in out]
    assert sorted(order) == list(range(2000))
    assert sum(a < b for a, b in zip(order, order[1:])) in range(900, 1100)


def test_sharding_few_or_none(spark, tmp_path):
    assert shard_rows(empty_docs(spark)).count() == 0
    few = odd_docs(spark).limit(3)
    assert sorted(r["shard"] for r in shard_rows(few).collect()) == [0, 1, 2]
    write_shards(odd_docs(spark), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 11
