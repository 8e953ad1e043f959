"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.staging import stage


def connect(edges: DataFrame, seed: int = 42) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b``: two nodes share a label if and only if linked.

    Each round gives every node the closed neighbour of least hash, with new hashes each time, and keeps
    the edges between unlike ones; the expected number of nodes falls by a constant factor, whatever the
    shape of the graph. Minima combine before the shuffle, so a hub costs no more than its edges. Loops and
    edges with a null end are passed over.
    """
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    rounds = 0
    while not edges.isEmpty():
        rounds += 1

        def rank(node: Column) -> Column:
            return F.struct(F.xxhash64(F.lit(seed + rounds), node).alias("h"), node.alias("n"))

        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        parents = stage(least.select("node", F.least(F.col("m"), rank(F.col("node")))["n"].alias("parent")), "parents")
        to = [parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in ("a", "b")]
        edges = stage(
            edges.join(to[0], "a").join(to[1], "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            moved = parents.select(F.col("node").alias("label"), F.col("parent").alias("to"))
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stage(labels, "labels")
