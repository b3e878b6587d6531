"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the corpus: distinct ones of least id hash, about ``PIVOT_RATE`` times the square root of the number of vectors. Each
vector is known by its ``NEAREST`` pivots in order of nearness. Its nearest pivot gives its shard: pivots are split along their own
spread until a leaf's vectors are at most about ``SHARD`` (a single pivot with more is dealt into parts). A query visits the shards of
its own nearest pivots only, in blocks of at most about ``BLOCK``, so for a large table what is shuffled grows with queries, not with queries times vectors. In a
shard each vector is posted with its rank into the inverted file of each of its pivots; a query visits the files of its pivots and adds up the
footrule distance; a pivot that is not among a vector's counts as its full length. With pivots as the root of the vectors, the postings a query meets
grow with that root as well. The vectors of least footrule, ``RERANKED`` times the root in all, dealt to shards by the query's pivots
in them, are reranked by inner product in double precision on the original vectors.

Inner products are brought to nearness by norms: vectors are indexed in bands of norms within a factor of two, each lifted to equal norms by one more
component; every band is searched. Pivots and the map from pivots to shards travel with the tasks: at most ``PIVOTS_MOST`` vectors.
Every vector is indexed. Recall is measured against brute force in the tests and stated in the README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows without
vec_id; vectors are compared with those of their own length; equal scores go to the smaller vec_id; repeated rows are candidates of their own except
for the query's own id; fewer candidates than asked for are all given; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back_memory

NEAREST, TOP, PIVOT_RATE, RERANKED = 96, 20, 8, 12
PIVOTS_LEAST, PIVOTS_MOST = 256, 16_384
SHARD, BLOCK = 16_384, 1024
#: Vectors of a shard that are reranked at least, and how many more than its part.
LEAST, SLACK = 96, 1.5
#: Bands of norms start at these many times a power of two, away from the common norm of one.
BAND = 1.4


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def pivots_wanted(n: int) -> int:
    """A power of two of about PIVOT_RATE sqrt(n)."""
    return min(PIVOTS_MOST, max(PIVOTS_LEAST, 1 << round(log2(PIVOT_RATE * sqrt(max(n, 1))))))


def bands(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's band of norms, and the vector over its band's upper norm with one component more, all of norm one."""
    largest = np.abs(vectors).max(axis=1)
    scaled = vectors / largest[:, None]  # squares neither overflow nor vanish
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    band = np.floor(np.log2(largest) + np.log2(norm * BAND)).astype(np.int64)
    ratio = np.exp2(np.log2(largest) + np.log2(norm * BAND) - band - 1)  # norm over the band's upper end
    unit = scaled * (ratio / norm)[:, None]
    more = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))
    return band, np.hstack([unit, more[:, None]]).astype(np.float32)


def lifted_query(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return np.hstack([unit, np.zeros((len(unit), 1))]).astype(np.float32)


def ordered_pivots(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    near = -(lifted @ pivots.T)
    k = min(NEAREST, len(pivots))
    some = np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(near), 1))
    by = np.lexsort((some, np.take_along_axis(near, some, 1)), axis=1)
    return np.take_along_axis(some, by, 1).astype(np.uint16)


def shards_of(pivots: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pivot's first shard and its number of parts; near pivots share a shard."""
    first, parts, made = np.zeros(len(pivots), np.int32), np.ones(len(pivots), np.int32), 0
    stack = [np.arange(len(pivots))]
    while stack:
        some = stack.pop()
        held = int(counts[some].sum())
        if len(some) == 1 or held <= most:
            first[some] = made
            if len(some) == 1:
                parts[some] = max(1, -(-held // most))
            made += int(parts[some].max())
            continue
        x = pivots[some]
        far = x[np.argmin(x @ x[0])]
        other = x[np.argmin(x @ far)]
        order = np.argsort(x @ (far - other), kind="stable")
        running = np.cumsum(counts[some][order])
        at = min(max(1, int(np.searchsorted(running, held / 2))), len(some) - 1)
        stack += [some[order[:at]], some[order[at:]]]
    return first, parts


class InvertedFiles:
    """Per pivot the vectors that it is near to, with its rank among their pivots."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.k = order.shape
        by = np.argsort(order.ravel(), kind="stable")
        self.vector, self.rank = (by // self.k).astype(np.int32), (by % self.k).astype(np.int16)
        self.edge = np.searchsorted(order.ravel()[by], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Distances less the constant that all vectors have in common."""
        a, b = self.edge[query], self.edge[query.astype(np.int64) + 1]
        vector = np.concatenate([self.vector[x:y] for x, y in zip(a, b)])
        nearness = self.k - np.abs(np.concatenate([self.rank[x:y] for x, y in zip(a, b)]) - np.repeat(np.arange(len(query)), b - a))
        return -np.bincount(vector, nearness, self.n)


def search_shard(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, q_order: np.ndarray, keep: np.ndarray, pivots: int, top: int = TOP):
    """(query, vec, score) of the shard's best for each query; ``keep``: how many to rerank for each."""
    files = InvertedFiles(order, pivots)
    for q, query, near_pivots, most in zip(q_ids, queries, q_order, keep):
        if most < len(ids):
            rule = files.footrule(near_pivots)
            near = np.argpartition(rule, most - 1)[:most]
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != q]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (vectors[near] * query).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:top]
        yield np.full(len(best), q), ids[near[best]], score[best]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _orders(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, k)


def _index(width: int, pivots: np.ndarray, query: bool):
    """vec_id, band (null for queries), home (nearest pivot), v, pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                vectors = _matrix(batch.column("v"), width)
                band, lifted = (np.zeros(len(vectors), np.int64), lifted_query(vectors)) if query else bands(vectors)
                order = ordered_pivots(lifted, pivots)
                binary = pa.array([o.tobytes() for o in order], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(band), pa.array(order[:, 0].astype(np.int32)), batch.column("v"), binary], ["vec_id", "band", "home", "v", "near"]
                )
        give_back_memory()

    return run


def _of_width(data: DataFrame, asked: DataFrame, width: int, n: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each visited shard."""
    wanted = pivots_wanted(n)
    chosen = data.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(2 * wanted).select("v").toArrow()  # bounded
    some = _matrix(chosen["v"], width)
    _, first = np.unique(some, axis=0, return_index=True)  # copies of one vector are one pivot
    _, pivots = bands(some[np.sort(first)[:wanted]])
    k = min(NEAREST, len(pivots))
    element = data.schema["v"].dataType.elementType.simpleString()
    schema = f"vec_id long, band long, home int, v array<{element}>, near binary"
    indexed = cut(data.mapInArrow(_index(width, pivots, False), schema), "index")
    queries = cut(asked.mapInArrow(_index(width, pivots, True), schema), "queries")
    held: dict[int, np.ndarray] = {}
    for r in indexed.groupBy("band", "home").count().collect():  # at most one a pivot in each band of norms
        held.setdefault(r["band"], np.zeros(len(pivots), np.int64))[r["home"]] = r["count"]
    shard_at, parts_at, total, keep_of = {}, {}, 0, {}
    for band, counts in sorted(held.items()):
        first, parts = shards_of(pivots, counts, SHARD)
        shard_at[band], parts_at[band] = first + total, parts
        total = int((shard_at[band] + parts).max())
        keep_of[band] = RERANKED * sqrt(counts.sum())
    of_shard = {}
    for band, firsts in shard_at.items():
        for s, p in set(zip(firsts.tolist(), parts_at[band].tolist())):
            of_shard.update({s + j: (band, s, p) for j in range(p)})

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's one shard."""
        for batch in batches:
            ids, home, band = (batch.column(c).to_numpy() for c in ("vec_id", "home", "band"))
            first = np.array([shard_at[b][h] for b, h in zip(band, home)], np.int32)
            parts = np.array([parts_at[b][h] for b, h in zip(band, home)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(first + (ids % parts).astype(np.int32)), batch.column("v"), batch.column("near")], names)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's shards, each once, with how many vectors it reranks there."""
        for batch in batches:
            rows, shard, keep = [], [], []
            for i, order in enumerate(_orders(batch.column("near"), k)):
                weight = np.arange(k, 0, -1.0)
                weight /= weight.sum()
                for band, firsts in shard_at.items():
                    there, at = np.unique(firsts[order], return_inverse=True)
                    share = np.bincount(at, weight)
                    for s, part in zip(there.tolist(), share.tolist()):
                        parts = of_shard[s][2]
                        rows += [i] * parts
                        shard += range(s, s + parts)
                        keep += [max(LEAST, ceil(SLACK * part * keep_of[band] / parts))] * parts
            taken = pa.array(rows, pa.int32())
            out = [batch.column("vec_id").take(taken), pa.array(shard, pa.int32()), batch.column("v").take(taken), batch.column("near").take(taken)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(keep, pa.int32())], [*names, "keep"])

    names = ["vec_id", "shard", "v", "near"]
    schema = f"vec_id long, shard int, v array<{element}>, near binary"
    placed = indexed.mapInArrow(to_shards, schema)
    visiting = queries.mapInArrow(visits, schema + ", keep int")
    # blocks of a shard's queries: as many as its queries need, known from counts
    counted = queries.mapInArrow(visits, schema + ", keep int").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = cut(counted, "visits")  # one row a shard
    every = blocks.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    placed = placed.join(F.broadcast(every), "shard")
    one = blocks.select("shard", (F.col("blocks") + 0).alias("of"))
    visiting = visiting.join(F.broadcast(one), "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(13)), "of").cast("int")).drop("of")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            ids = lambda t: t["vec_id"].to_numpy()
            parts = list(
                search_shard(
                    ids(left), _matrix(left["v"], width), _orders(left["near"], k), ids(right), _matrix(right["v"], width), _orders(right["near"], k), right["keep"].to_numpy(), len(pivots), top
                )
            )
        q, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    return placed.groupBy("shard", "block").cogroup(visiting.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``top`` found for each query row, among all vectors but its own."""
    kept = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    clean = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("v")).filter("vec_id is not null").filter(usable(F.col("v")))
    data, asked = clean(vectors), clean(queries)
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in data.groupBy(F.size("v").alias("width")).count().orderBy("width").collect():  # one row a length of vectors
        of_width = lambda d: d.filter(F.size("v") == r["width"])  # noqa: E731, B023
        found = found.unionByName(_of_width(of_width(data), of_width(asked), r["width"], r["count"], top))
    # at most ``top`` rows from each shard: added up by hash first, so no list grows with the number of shards
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score")))
    step = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    some = step.groupBy("query_id", "part").agg(F.slice(best, 1, top).alias("b")).select("query_id", F.inline("b"))
    return some.groupBy("query_id").agg(F.slice(best, 1, top).alias("b")).select("query_id", F.posexplode("b").alias("rank", "e")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score")
    )


def search_every(vectors: DataFrame, step: int = 20) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``step``."""
    table = cut(vectors.select("vec_id", "embedding"), "vectors")
    return nearest(table, table.filter(F.col("vec_id") % step == 0).dropDuplicates(["vec_id"]))
