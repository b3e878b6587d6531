"""N-gram Jaccard join: a size-aware heavy-light join, given as components of linked documents.

A document's set is its distinct word shingles. Two sets link when 100 * |A and B| >= ``PERCENT`` * |A or B|, so they share at
least c(n, m) = ceil(PERCENT * (n + m) / (100 + PERCENT)) shingles.

Equal sets are one class first, known by its least doc_id; only classes are joined.
Light: for sets of at most x shingles, all subsets of c(n, m) shingles are enumerated for each partner size m; a
shared subset proves a link, and a list of sets with one subset is linked to its first member, never pair by pair.
Heavy: larger sets (and those small ones that may link to them) scan inverted lists. A set posts its rarest shingles only, n - ceil(t n) + ``SHARED``
of them: linked sets share at least SHARED of their postings. Rarity comes from a fixed-size count of all shingles of all documents; any
fixed order gives the same links, this one keeps boilerplate out of the lists.
The boundary x is chosen by cost: subsets enumerated against shingles posted and verified, over the counted sizes.

An inverted list is not turned into all its pairs: each set first meets one list leader and is verified against it
exactly; after that only lists that still hold several components go on, with new leaders while their pairs would be many; of
the pairs left, all whose number of shared postings allows a link are verified. So no link between components is lost.

Lists, leaders and components of very many rows are dealt over tasks or joined map-side (``heavy_join``, ``salted_join``).

Defined cases: null, empty or blank text has an empty set, linked with nothing, and is its own component; texts of fewer
words than a shingle are one shingle; repeated rows are one class; rows without doc_id take no part (component null);
rows that share an id but not their set are documents of their own, each with the component of its text; an empty table gives an empty result; extra
columns are not carried by ``jaccard_components`` and all are by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import cut, free_name, heavy_join, remove, salted_join, split_by_keys, text_slices
from .components import components

SHINGLE, PERCENT = 4, 85
#: Postings that linked sets share.
SHARED = 3
#: Largest set size for which subsets may be enumerated at all.
LIGHT_MOST = 24
#: log2 of the counters, and counters in a chunk.
COUNTER_BITS, CHUNK = 20, 1 << 14
#: Pairs of places in lists that may be compared, for each posting, without another leader round.
COMPARED = 64
#: Pairs of places in one list that one task compares, about.
TASK_PAIRS = 1 << 24
#: Leader rounds at most before all pairs that are left are verified.
ROUNDS = 6

_SALT = np.uint64(0x5851F42D4C957F2D)


def needed(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def least_share(n: int, percent: int) -> int:
    """ceil(t n): shingles of a set that any partner must hold."""
    return -(-percent * n // 100)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle codes of each text."""
    flat, offsets = W.split(texts, lower=True)
    codes = W.codes(flat)
    runs = W.run_codes(codes, size)
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            # with the length, as runs of different lengths may have one code
            yield W.join(W.run_codes(codes[a:b], int(b - a)), np.full(1, b - a, np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _prints(codes: np.ndarray) -> tuple[int, int]:
    """A 128-bit print of a set."""
    return W.mix(codes).sum(dtype=np.uint64), W.mix(codes ^ _SALT).sum(dtype=np.uint64)


def _census(shingle: int):
    """A row a document (size and 128-bit print of its set); and the partition's counts of shingles, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        names = ["doc_id", "n", "print_a", "print_b", "chunk", "counts"]
        for batch in text_slices(batches, "text"):
            size, a, b, all_codes = [], [], [], []
            for codes in shingle_sets(batch.column("text"), shingle):
                size.append(len(codes))
                for prints, value in zip((a, b), _prints(codes)):
                    prints.append(value)
                all_codes.append(codes >> np.uint64(64 - COUNTER_BITS))
            rows = len(size)
            seen, times = np.unique(np.concatenate(all_codes).astype(np.int32), return_counts=True)
            counts[seen] += times.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                names,
            )
        if counts.any():
            chunks = counts.reshape(-1, CHUNK)
            rows = len(chunks)
            none = [pa.nulls(rows, pa.int64())] * 4
            binary = pa.array([c.astype("<u8").tobytes() for c in chunks], pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(rows), pa.int32()), binary], names)

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each chunk in the partition; memory is one table of counters."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            values = np.frombuffer(counts.as_buffer(), "<u8")
            sums[chunk] = sums[chunk] + values if chunk in sums else values
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.astype("<u8").tobytes() for v in sums.values()], pa.binary())],
            ["chunk", "counts"],
        )


def _common(counts: DataFrame, bound: int) -> np.ndarray:
    """How common the shingles of each counter are: 0 up to the bound, then one more a doubling. 1 MB, whatever the input."""
    schema = "chunk int, counts binary"
    salted = counts.repartition(F.col("chunk"), F.pmod(F.spark_partition_id(), F.lit(8))).mapInArrow(_add_chunks, schema)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _add_chunks(batches):  # in one function, as a second one would need a worker of its own
            level = [np.ceil(np.log2(np.maximum(np.frombuffer(c.as_buffer(), "<u8") / bound, 1))).astype(np.uint8).tobytes() for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(level, pa.binary())], ["chunk", "counts"])

    out = np.zeros(((1 << COUNTER_BITS) // CHUNK, CHUNK), np.uint8)
    for row in salted.repartition("chunk").mapInArrow(levels, schema).collect():  # 64 rows of 16 KB
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def light_cost(n: int, x: int, percent: int) -> int:
    """Subset rows of a set of n shingles among sets of at most x."""
    return sum(comb(n, needed(n, m, percent)) for m in partner_sizes(n, x, percent))


def partner_sizes(n: int, x: int, percent: int) -> list[int]:
    """Sizes of light partners whose needed subsets are not the set of both (that class is one already)."""
    low, high = least_share(n, percent), min(x, 100 * n // percent)
    return [m for m in range(low, high + 1) if needed(n, m, percent) <= min(n, m) and not n == m == needed(n, m, percent)]


def boundary(sizes: dict[int, int], percent: int, shared: int = SHARED) -> int:
    """The size x up to which subsets are enumerated, by least total cost over the counted sizes."""
    best, best_cost = 0, None
    for x in range(LIGHT_MOST + 1):
        cost = 0
        for n, count in sizes.items():
            if n <= x:
                cost += count * light_cost(n, x, percent)
            if n >= least_share(x + 1, percent):  # posted twice over, and its whole set moved for a check
                cost += count * (2 * min(n, n - least_share(n, percent) + shared) + n)
        if best_cost is None or cost < best_cost:
            best, best_cost = x, cost
    return best


def _entries(shingle: int, percent: int, x: int, common: np.ndarray):
    """Light rows (sizes low and high, subset as code, node, n) and postings (low null; code, node, n, how many of its postings are common, place)."""
    least = least_share(x + 1, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - COUNTER_BITS)
        names = ["low", "high", "code", "node", "n", "known", "at"]
        for batch in text_slices(batches, "text"):
            light, parts, sizes, docs, known = [], [], [], [], []
            for doc, codes in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), shingle)):
                n = len(codes)
                if 0 < n <= x:
                    mixed = [int(v) for v in W.mix(codes)]
                    for m in partner_sizes(n, x, percent):
                        for chosen in combinations(mixed, needed(n, m, percent)):
                            subset = (sum(chosen) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                            light.append((min(n, m), max(n, m), subset, doc, n, None, None))
                if n >= least:
                    rarest = codes[np.argsort(common[codes >> shift], kind="stable")]
                    parts.append(rarest[: min(n, n - least_share(n, percent) + SHARED)])
                    known.append(np.count_nonzero(common[parts[-1] >> shift]))
                    sizes.append(n)
                    docs.append(doc)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            if light:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*light), kinds)], names)
            if parts:
                lengths = [len(p) for p in parts]
                codes = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(codes), pa.int32()),
                        pa.nulls(len(codes), pa.int32()),
                        pa.array(codes.view(np.int64)),
                        pa.array(np.repeat(np.array(docs, np.int64), lengths)),
                        pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                        pa.array(np.repeat(np.array(known, np.int32), lengths)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
                    ],
                    names,
                )

    return run


def entries(docs: DataFrame, shingle: int, percent: int, x: int, common: np.ndarray) -> DataFrame:
    schema = "low int, high int, code long, node long, n int, known int, at int"
    return cut(docs.mapInArrow(_entries(shingle, percent, x, common), schema), "entries")


def light_links(entries: DataFrame) -> DataFrame:
    """Links (a, b) that connect all linked light sets."""
    rows = entries.filter("low is not null").select("low", "high", "code", "node", F.col("n").alias("size"))
    keys = ["low", "high", "code"]
    lists = cut(
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.min(F.when(F.col("size") == F.col("low"), F.col("node"))).alias("first_low"),
            F.min(F.when(F.col("size") == F.col("high"), F.col("node"))).alias("first_high"),
        )
        .filter("k > 1 and first_low is not null and first_high is not null"),
        "lists",
    )
    met = heavy_join(rows, lists, keys, rows.count(), "k")
    other = F.when(F.col("size") == F.col("low"), F.col("first_high")).otherwise(F.col("first_low"))
    return met.select(F.col("node").alias("a"), other.alias("b")).filter("a != b").distinct()


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), shingle))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["node", "codes"]
            )

    return run


def _linked(percent: int):
    """Keep the pairs whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = left.values.to_numpy(zero_copy_only=False), right.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The written pairs (a, b) whose whole sets link; a written table. Only the pairs' texts are read into sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members, _ = split_by_keys(docs, nodes, "node")
    sets = cut(members.mapInArrow(_sets(shingle), "node long, codes array<long>"), "sets")
    # a node may be in a large part of all pairs, as leaders are
    total = pairs.count()
    left = salted_join(pairs, sets.select(F.col("node").alias("a"), F.col("codes").alias("left")), "a", "b", pairs, total)
    both = salted_join(left, sets.select(F.col("node").alias("b"), F.col("codes").alias("right")), "b", "a", pairs, total)
    out = cut(both.select("a", "b", "left", "right").mapInArrow(_linked(percent), "a long, b long"), "links")
    remove(sets)
    return out


def heavy_links(docs: DataFrame, entries: DataFrame, shingle: int, percent: int, links: DataFrame) -> DataFrame:
    """Links that connect all linked sets of which one at least is heavy, added to those given; a written table."""
    postings = entries.filter("low is null").select("code", "node", "n", "known", "at")
    total = postings.count()
    lists = cut(
        postings.groupBy("code")
        .agg(F.count(F.lit(1)).alias("k"), F.min(F.struct((-F.col("known")).alias("most"), "n", "node")).alias("leader"))
        .filter("k > 1")
        .select("code", "k", F.col("leader.n").alias("leader_n"), F.col("leader.node").alias("leader")),
        "lists",
    )
    alive = cut(heavy_join(postings, lists, ["code"], total, "k"), "alive")
    remove(entries)
    remove(lists)
    near = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def enough(shared, n, m):
        """Can sets of n and m that share so many postings link? What they share elsewhere lies outside the postings of one."""
        posted = lambda k: F.least(k, k - F.ceil(k * percent / 100) + SHARED)
        return (shared + F.greatest(n - posted(n), m - posted(m))) * (100 + percent) >= (n + m) * percent

    # each set meets the leader it shares most lists with; a list's leader has most common postings, so it lies amid its copies
    met = (
        alive.filter("node != leader")
        .filter(near(F.col("n"), F.col("leader_n")))
        .groupBy("node", "leader", "n", "leader_n")
        .agg(F.count(F.lit(1)).alias("votes"))
        .filter(enough(F.col("votes"), F.col("n"), F.col("leader_n")))
        .groupBy("node")
        .agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader"))
    )
    pairs = cut(met.select(F.col("node").alias("a"), F.col("leader").alias("b")), "pairs")
    links = cut(links.unionByName(verified(pairs, docs, shingle, percent)), "links")
    postings = alive.select("code", "node", "n", "at")
    for turn in range(ROUNDS + 1):
        labels = components(links)
        placed = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = cut(placed, "placed")
        by_component = placed.groupBy("code", "component").agg(
            F.count(F.lit(1)).alias("k"),
            F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), F.struct("node", "n", "component").alias("of"))).alias("first"),
        )
        open_lists = cut(
            by_component.groupBy("code")
            .agg(
                F.sum("k").alias("k"),
                F.sum(F.col("k") * F.col("k")).alias("within"),
                F.max(F.struct("k", "component")).alias("main"),
                F.min("first").alias("first"),
                F.count(F.lit(1)).alias("held"),
            )
            .filter("held > 1")
            .select(
                "code",
                "k",
                "within",
                F.col("main.component").alias("main"),
                F.col("first.of").alias("first"),
                F.ceil(F.col("k") * (F.col("k") - F.col("main.k")) / TASK_PAIRS).cast("int").alias("parts"),
            ),
            "open",
        )
        size = open_lists.agg(F.sum((F.col("k") * F.col("k") - F.col("within")) / 2).alias("pairs"), F.sum("k").alias("rows")).first()
        if not size["rows"]:
            break
        last = size["pairs"] <= COMPARED * total or turn == ROUNDS
        rows = heavy_join(placed, open_lists, ["code"], total, "k")
        if last:
            # in each list only sets outside its largest component are paired, with sets of other components
            # a list of many such sets is dealt over parts: each set to one of them, those outside to all
            held = cut(rows.select("code", "node", "n", "at", "component", "main", "parts"), "rows")
            others = [F.col(c).alias(f"{c}_b") for c in ("node", "n", "at", "component")]
            outside = held.filter("component != main").select("code", *others, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            held = held.withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), "parts").cast("int"))
            # a pair of sizes that must share c shingles shares r of its first n - c + r and m - c + r, for any r
            c = F.ceil((F.col("n") + F.col("n_b")) * percent / (100 + percent))
            r = SHARED + F.floor((c - F.ceil(F.greatest("n", "n_b") * percent / 100)) / 3)
            chosen = (
                held.join(outside, ["code", "part"])
                .filter("component != component_b and (component = main or node < node_b)")
                .filter(near(F.col("n"), F.col("n_b")))
                .filter((F.col("at") < F.col("n") - c + r) & (F.col("at_b") < F.col("n_b") - c + r))
                # a pair comes either way round, as the largest component differs from list to list: count it as one
                .groupBy(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
                .agg(F.count(F.lit(1)).alias("shared"), F.first(r).alias("r"))
                .filter("shared >= r")
                .select("a", "b")
            )
        else:
            chosen = (
                rows.filter("component != first.component")
                .filter(near(F.col("n"), F.col("first.n")))
                .withColumn("first_n", F.col("first.n"))
                .groupBy(F.col("node").alias("a"), F.col("first.node").alias("b"), "n", "first_n")
                .agg(F.count(F.lit(1)).alias("votes"))
                .filter(enough(F.col("votes"), F.col("n"), F.col("first_n")))
                .select("a", "b")
            )
        new = verified(cut(chosen, "pairs"), docs, shingle, percent)
        links = cut(links.unionByName(new), "links")
        remove(placed)
        remove(open_lists)
        if last:
            break
    return links


def _print_columns(shingle: int, names: list[str], text: str):
    """The rows of docs with their sets' prints after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            prints = [_prints(codes) for codes in shingle_sets(batch.column(text), shingle)]
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*prints)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return run


def with_nodes(docs: DataFrame, several: DataFrame | None, name: str, shingle: int) -> DataFrame:
    """docs with their node: the doc_id, or for ids of ``several`` sets a hash of id and print."""
    docs = docs.withColumn(name, F.col("doc_id").cast("long"))
    if several is None:
        return docs
    maybe, rest = split_by_keys(docs, several.select(F.col("doc_id").alias(name)), name)
    ids = several.select(F.col("doc_id").alias("several_id")).hint("merge")
    same = maybe[name] == ids["several_id"]
    a, b = free_name(docs, "print_a"), free_name(docs, "print_b")
    schema = T.StructType([*docs.schema.fields, T.StructField(a, T.LongType()), T.StructField(b, T.LongType())])
    marked = maybe.join(ids, same, "left_semi").mapInArrow(_print_columns(shingle, schema.names, "text"), schema)
    marked = marked.withColumn(name, node_hash(name, a, b)).drop(a, b)
    return marked.unionByName(maybe.join(ids, same, "left_anti")).unionByName(rest)


def node_hash(doc: str, a: str, b: str) -> Column:
    return F.xxhash64(doc, a, b, F.lit(29))


def linked(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Per row (doc_id, node, n, class_id, component_id, keep_node), rows that take no part, and the ids of several sets.

    keep_node is the node of the component's least doc_id."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n long, print_a long, print_b long, chunk int, counts binary"
    census = cut(text.mapInArrow(_census(shingle), schema), "census")
    sized = census.filter("chunk is null").drop("chunk", "counts")
    counts = census.filter("chunk is not null").select("chunk", "counts")
    prints = ["n", "print_a", "print_b"]
    extremes = sized.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*prints)).alias("low"), F.max(F.struct(*prints)).alias("high"))
    several: DataFrame | None = cut(extremes.filter("low != high").select("doc_id"), "several")
    if several.limit(1).count() == 0:
        several = None
        noded = sized.withColumn("node", F.col("doc_id"))
    else:
        maybe, rest = split_by_keys(sized, several, "doc_id")
        found = maybe.join(several.withColumn("many", F.lit(True)).hint("merge"), "doc_id", "left")
        node = F.when(F.col("many"), node_hash("doc_id", "print_a", "print_b")).otherwise(F.col("doc_id"))
        noded = found.withColumn("node", node).drop("many").unionByName(rest.withColumn("node", F.col("doc_id")))
    real = noded.filter("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "node"))
    classes = cut(real.groupBy(*prints).agg(first.alias("first"), F.count(F.lit(1)).alias("k")), "classes")
    sums = real.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).first()
    joined = heavy_join(real, classes, prints, sums["docs"], "k")
    member = cut(joined.select("doc_id", "node", "n", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("class_node")), "members")
    # the texts of classes' first members: others are dropped by their nodes, of which few are shuffled
    copies = cut(member.filter("node != class_node").select("node").distinct(), "copies")
    texts = with_nodes(text.filter("doc_id is not null"), several, "node", shingle).select("node", "text")
    maybe, single = split_by_keys(texts, copies, "node")
    firsts = maybe.join(copies.hint("merge"), "node", "left_anti").unionByName(single)

    small = classes.filter(F.col("n") <= 2 * LIGHT_MOST).groupBy("n").count().collect()  # at most 48 rows
    x = boundary({int(r["n"]): int(r["count"]) for r in small}, percent)
    mean = int(sums["shingles"] or 0) >> COUNTER_BITS
    common = _common(counts, 2 * mean + max(32, sums["docs"] // 1000))
    both = entries(firsts, shingle, percent, x, common)
    links = heavy_links(firsts, both, shingle, percent, cut(light_links(both), "links"))
    found = components(links)
    if several is None:
        keepers = found.select(F.col("node").alias("class_node"), F.col("component").alias("component_id"), F.col("component").alias("keep_node"))
    else:  # hashes stand for some nodes, so the least doc_id of each component is looked up
        named = found.join(classes.select("first.node", F.col("first.doc_id").alias("doc_id")), "node")
        least = cut(named.groupBy("component").agg(first.alias("least"), F.count(F.lit(1)).alias("k")), "least")
        keepers = heavy_join(found, least, ["component"], sums["docs"], "k").select(
            F.col("node").alias("class_node"), F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("keep_node")
        )
    rows = member.join(keepers, "class_node", "left").select(
        "doc_id",
        "node",
        "n",
        "class_id",
        F.coalesce("component_id", "class_id").alias("component_id"),
        F.coalesce("keep_node", "class_node").alias("keep_node"),
    )
    return rows, sized.filter("n = 0 or doc_id is null").select("doc_id", "n"), several


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable by links), class_id."""
    rows, rest, _ = linked(docs, shingle, percent)
    rest = rest.select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", "class_id", "component_id").unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the least doc_id; of repeated rows one. All columns stay; rows that take no part stay."""
    rows, _, several = linked(docs, shingle, percent)
    rows = cut(rows.groupBy("node").agg(F.first("keep_node").alias("keep_node"), F.count(F.lit(1)).alias("k")), "rows")
    name = free_name(docs, "node")
    noded = with_nodes(docs, several, name, shingle)
    gone = rows.filter("node != keep_node").select(F.col("node").alias("gone_node"))
    maybe, stay = split_by_keys(noded, gone.select(F.col("gone_node").alias(name)), name)
    gone = gone.hint("merge")
    kept = maybe.join(gone, maybe[name] == gone["gone_node"], "left_anti").unionByName(stay)
    repeated = rows.filter("node = keep_node and k > 1").select(F.col("node").alias("repeated_node"))
    if repeated.limit(1).count():
        maybe, single = split_by_keys(kept, repeated.select(F.col("repeated_node").alias(name)), name)
        repeated = repeated.hint("merge")
        same = maybe[name] == repeated["repeated_node"]
        several_rows = maybe.join(repeated, same, "left_semi").dropDuplicates([name])
        kept = several_rows.unionByName(maybe.join(repeated, same, "left_anti")).unionByName(single)
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])
