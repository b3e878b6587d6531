"""Exact dedup by a heavy-hitter split, DataFrame functions only.

Method. (1) One pass over the texts writes ``(doc_id, digest)``; nothing later touches the text.
(2) A Misra-Gries summary (Spark's ``approx_top_k``, a Misra-Gries frequent-items sketch with
partial aggregates merged over tasks) proposes frequent digests. (3) Proposals are verified by exact
counts over all rows; those with at least two rows are the winners, at most ``CANDIDATES`` of them, so
their broadcast is bounded. (4) Rows with a winning digest find their keeper map-side, without a
shuffle. (5) All other digests use an ordinary shuffle; a digest the summary did not propose holds at
most a small, bounded share of the rows: at most one in CANDIDATES.

Defined cases: null text counts as empty and equals "" ; texts are equal when they are after whitespace runs become one space. Of
equal texts exactly one row stays, the one with the smallest doc_id; a null doc_id loses to any other, and of rows with the same id the first read
stays. Rows that share an id but not their text are different documents and all stay. An empty
table gives an empty result; ``exact_dedup`` does not carry extra columns, ``keep_first`` carries all of any type and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, cut, free_name, heavy_join, split_by_keys

#: Number of proposals that are verified, and counters of the summary.
CANDIDATES = 256
COUNTERS = 4096
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(blank(text), SPACES, " ")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, digest, keep_id, group_size, kept."""
    digests = cut(
        docs.select(
            F.col(key).alias("doc_id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("place"),  # tells rows of one id apart; written, so it stays
        ),
        "digests",
    )
    # (2) proposals: the summary takes strings
    top = digests.select(F.hex("digest").alias("h")).agg(F.expr(f"approx_top_k(h, {CANDIDATES}, {COUNTERS})").alias("t"))
    proposed = top.select(F.explode("t").alias("e")).select(F.unhex("e.item").alias("digest"))
    # (3) exact counts of the proposals, added up map-side before a shuffle of at most CANDIDATES keys
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("place"))).alias("first")
    counted = [F.count(F.lit(1)).alias("group_size"), least]
    winners = cut(digests.join(F.broadcast(proposed), "digest").groupBy("digest").agg(*counted).filter("group_size > 1"), "winners")
    # (4) map-side
    hot = digests.join(F.broadcast(winners), "digest")
    # (5) ordinary shuffle of added-up counts; rows alone in their group need no keeper
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = cut(rest.groupBy("digest").agg(*counted).filter("group_size > 1"), "groups")
    several, single = split_by_keys(rest, groups, "digest")
    several = heavy_join(several, groups, ["digest"], digests.count(), "group_size", "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("place"))
    single = single.select("digest", "doc_id", "place", F.lit(1).cast("long").alias("group_size"), own.alias("first"))
    both = hot.unionByName(several).unionByName(single)
    first = F.coalesce("first", own)
    return both.select(
        "doc_id", "digest", first["doc_id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("place") == first["place"]).alias("kept")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return kept_rows(docs, key, text).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay. Rows go by id and digest, so a row that only shares an id stays.

    Digests are computed again only for rows whose id may be one of a dropped row's.
    """
    rows = kept_rows(docs, key, text)
    gone = cut(rows.filter(~F.col("kept")).groupBy("doc_id", "digest").agg(F.first("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "gone")
    maybe, stay = split_by_keys(docs, gone.select(F.col("doc_id").alias(key)), key)
    digest = free_name(docs, "digest")
    maybe = maybe.withColumn(digest, F.unhex(F.sha2(normalised(text), 256)))
    repeated = F.col("doc_id").eqNullSafe(F.col("keep_id"))  # the kept row's id is also that of rows that go
    if gone.filter((F.col("n") > 1) | repeated).limit(1).count():
        maybe = maybe.dropDuplicates([key, digest])  # rows of one id and text become one, map-side first
    away = gone.filter(~repeated).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).hint("merge")
    kept = maybe.join(away, maybe[key].eqNullSafe(away["_id"]) & (maybe[digest] == away["_digest"]), "left_anti")
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns]).unionByName(stay)


ORACLE_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
