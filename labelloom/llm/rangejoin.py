"""Exact range join of vectors by cosine, in cells around pivots.

On unit vectors the Euclidean distance is a metric and a cosine of at least ``t`` is a distance of at most
``r = sqrt(2 - 2 t)``. Every vector has its home in the cell of its nearest pivot. A vector ``v`` within ``r`` of one
whose home is another cell is copied there; by the triangle inequality that takes

* d(v, pivot) <= r + the largest distance of a home vector from that pivot, and
* d(v, pivot) - d(v, own pivot) <= 2 r.

Both are tested, and the sharper form of the second for Euclidean space: the distance of ``v`` from the plane
half-way between the pivots is at most ``r``. Cells then join independently, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.components import connect
from labelloom.llm.vectors import matrix, usable
from labelloom.staging import stage

PIVOTS, BLOCK = 8, 4096
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows by their lengths. A power of two, which rounds nothing, first brings the largest component near one, so that no square overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivot_distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ pivots.T)))


def members(d: np.ndarray, pivots: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
    """For vectors with distances ``d`` to the pivots: in which cells each must be (its home included)."""
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home][:, None]
    between = np.linalg.norm(pivots[home][:, None, :] - pivots[None, :, :], axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(between > 0, (d**2 - own**2) / (2 * between), 0.0)
    out = (d - own <= 2 * radius + SLACK) & (d <= reach + radius + SLACK) & (plane <= radius + SLACK)
    out[np.arange(len(d)), home] = True
    return out


def bipartite_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a boolean link matrix."""
    rows, cols, out = linked.any(axis=1), np.ones(linked.shape[1], bool), []
    for first in np.flatnonzero(rows):
        if not rows[first]:
            continue
        rows[first], queue = False, [(True, first)]
        while queue:
            is_row, i = queue.pop()
            if is_row:
                found = np.flatnonzero(linked[i] & cols)
                cols[found] = False
                out += [(i, j) for j in found]
            else:
                found = np.flatnonzero(linked[:, i] & rows)
                rows[found] = False
                out += [(j, i) for j in found]
            queue += [(not is_row, j) for j in found]
    return out


def cell_links(cell: pa.Table, threshold: float) -> pa.Table:
    """Links of the home vectors of one block with the members of another: counts, and a forest of them."""
    home, member = (cell.filter(cell.column(c)) for c in ("is_home", "is_member"))
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not home.num_rows or not member.num_rows:
        return empty
    u, v = (unit(matrix(x.column("embedding"), float)) for x in (home, member))
    a, b = home.column("node").to_numpy(), member.column("node").to_numpy()
    linked = (u @ v.T >= threshold) & (a[:, None] != b[None, :])
    counts = linked @ member.column("copies").to_numpy().astype(np.int64)
    edges = np.array(bipartite_forest(linked), np.int64).reshape(-1, 2)
    some = np.flatnonzero(counts)
    return pa.table(
        {
            "a": pa.array(np.concatenate([a[some], a[edges[:, 0]]])),
            "b": pa.array(np.concatenate([np.full(len(some), -1), b[edges[:, 1]]])),
            "n": pa.array(np.concatenate([counts[some], np.zeros(len(edges), np.int64)])),
        }
    )


def range_links(nodes: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """``a, b, n`` for ``nodes`` (node, label, dims, copies, embedding), all distinct.

    Rows with ``b = -1`` say that ``n`` vectors (copies counted) link with ``a``; the others are links that connect
    what is linked. Pivots are the ``pivots`` vectors of least hash among those of the most common length;
    vectors of other lengths are few kinds and stay in one cell for each label and length.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    lengths = nodes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    picked = nodes.where(F.col("dims") == dims).orderBy(F.xxhash64("embedding"), "node").limit(pivots).select("embedding").toArrow()
    centres = unit(matrix(picked.column(0), float)) if picked.num_rows else np.zeros((1, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in np.unique(batch.column("dims").to_numpy()):
                own = batch.filter(pa.compute.equal(batch.column("dims"), int(kind)))
                n = own.num_rows
                near = np.zeros((n, 1))
                if kind == dims:
                    near = pivot_distances(unit(matrix(own.column("embedding"), float)), centres)
                home, least = near.argmin(axis=1), near.min(axis=1)
                columns = [own.column(c) for c in ("label", "dims")] + [pa.array(home, pa.int32()), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, ["label", "dims", "cell", "d"])

    label = nodes.schema["label"].dataType.simpleString()
    homes = nodes.mapInArrow(measure, f"label {label}, dims int, cell int, d double")
    far = {r["cell"]: r["d"] for r in homes.where(F.col("dims") == dims).groupBy("cell").agg(F.max("d").alias("d")).collect()}
    reach = np.array([far.get(i, -np.inf) for i in range(len(centres))])

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in np.unique(batch.column("dims").to_numpy()):
                own = batch.filter(pa.compute.equal(batch.column("dims"), int(kind)))
                inside, home = np.ones((own.num_rows, 1), bool), np.zeros(own.num_rows, int)
                if kind == dims:
                    d = pivot_distances(unit(matrix(own.column("embedding"), float)), centres)
                    inside, home = members(d, centres, reach, radius), d.argmin(axis=1)
                row, cell = np.nonzero(inside)
                out = own.take(pa.array(row))
                extra = [pa.array(cell, pa.int32()), pa.array(home[row] == cell)]
                yield pa.RecordBatch.from_arrays(out.columns + extra, [*out.schema.names, "cell", "is_home"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", cell int, is_home boolean"
    dealt = stage(nodes.mapInArrow(copy, schema), "cells")
    counts = dealt.groupBy("label", "dims", "cell").agg(
        F.ceil(F.count_if("is_home") / BLOCK).alias("homes"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("all")
    )
    with_counts = dealt.join(counts.where("homes > 0"), ["label", "dims", "cell"])
    home_block, block = F.pmod(F.xxhash64("node"), F.col("homes")), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("all"))
    zero = F.lit(0).cast("long")
    as_home = F.transform(F.sequence(zero, F.col("all") - 1), lambda b: F.struct(home_block.alias("i"), b.alias("j"), F.lit(True).alias("h"), F.lit(False).alias("m")))
    as_member = F.transform(F.sequence(zero, F.col("homes") - 1), lambda a: F.struct(a.alias("i"), block.alias("j"), F.lit(False).alias("h"), F.lit(True).alias("m")))
    places = F.when(F.col("is_home"), F.concat(as_home, as_member)).otherwise(as_member)
    tasks = with_counts.select("label", "dims", "cell", "node", "copies", "embedding", F.explode(places).alias("p")).select(
        "label", "dims", "cell", "node", "copies", "embedding", "p.i", "p.j", F.col("p.h").alias("is_home"), F.col("p.m").alias("is_member")
    )
    return tasks.groupBy("label", "dims", "cell", "i", "j").applyInArrow(lambda t: cell_links(t, threshold), "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """Every vector with ``n_links`` and ``component_id`` (the smallest ``vec_id`` its links reach).

    Labels are of any type that can be a key. Vectors compare with those of equal, non-null label and equal length. Null, empty and zero vectors, and
    those with a null or non-finite component, link with nothing. Equal vectors are one node with a
    number of copies, so a vector that a third of the rows share is compared once. Rows with a null ``vec_id``
    count as links but lend their component no number.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    good = usable() & F.col("label").isNotNull() & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(good, F.col("embedding")))
    classes = rows.where(F.col("embedding").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("embedding").alias("dims"), "copies", "first", "embedding"), "nodes")
    found = stage(range_links(nodes.drop("first"), threshold), "links")
    counts = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = connect(found.where("b >= 0")).withColumnRenamed("label", "group")
    grouped = nodes.drop("embedding").join(labels, "node", "left").withColumn("group", F.coalesce("group", "node"))
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    known = (
        nodes.select("node", "label", "embedding", "copies")
        .join(grouped.select("node", "group"), "node")
        .join(smallest, "group")
        .join(counts, "node", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    )
    return (
        rows.join(known, ["label", "embedding"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
