"""Connected components of an edge table, by least labels with pointer jumping; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, heavy_join, remove


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least node reachable. A written table.

    Every round passes labels along edges and then to the label's own label; rounds grow with the logarithm of a
    chain's length. Nodes with very many edges and labels of very large components are joined map-side, all others
    shuffle (``heavy_join``). Each round is written, so a lost executor costs one round's work.
    """
    both = cut(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .filter("node != other")
        .distinct(),
        "edges",
    )
    total = both.count()
    # ``n`` is the number of a node's edges
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
    while True:
        heard = heavy_join(both, labels.withColumnRenamed("node", "other"), ["other"], total).select("node", "label")
        near = cut(heard.unionByName(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label")), "near")
        next_ = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumps = cut(near.groupBy("label").agg(F.count(F.lit(1)).alias("k")).join(next_, "label"), "jumps")
        jumped = heavy_join(near, jumps, ["label"], total, "k").select("node", F.least("label", "next").alias("label"))
        new = cut(jumped.join(labels.withColumnRenamed("label", "old"), "node"), "labels")
        changed = new.filter("label != old").limit(1).count()
        for table in (near, jumps, labels):
            remove(table)
        labels = new.select("node", "label", "n")
        if not changed:
            remove(both)
            return labels.select("node", F.col("label").alias("component"))
