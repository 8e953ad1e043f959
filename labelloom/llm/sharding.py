"""Shards along a Hilbert curve over metadata.

Documents close in every dimension are close on the curve, so each run of it that becomes a shard covers a
narrow range in each, and readers can skip files by their minima and maxima.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import in_order
from labelloom.staging import stage

BITS = 4


def level_cuts(df: DataFrame, column: str, bits: int = BITS) -> list:
    """The smallest value of each of at most ``2 ** bits`` levels that hold about as many rows each.

    Distinct values are counted and ordered on the executors; nulls are not counted. Only the cuts come
    to the driver.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    ordered = in_order(values, [column], "_rows")
    level = F.floor(F.col("_before_all") * (1 << bits) / max(1, ordered.weight))
    cuts = ordered.with_places("_place", "_before_all").groupBy(level.alias("level")).agg(F.min(column).alias("cut")).collect()
    return sorted(r["cut"] for r in cuts)


def level(column: str, cuts: Sequence) -> Column:
    """Number of cuts at or below the value, less one; null and values below all cuts are at level 0."""
    if not cuts:
        return F.lit(0)
    reached = [F.when(F.col(column) >= F.lit(c), 1).otherwise(0) for c in cuts]
    return F.greatest(F.lit(0), sum(reached[1:], reached[0]) - 1).cast("int")


def hilbert_index(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with ``bits`` bits in each dimension.

    Gray-coded from the highest bit down, exchanging and inverting the lower bits of the axes as the curve
    turns; the bits are then read across the axes.
    """
    x = np.array(levels, np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_bit = (x[i] & q) != 0
            swapped = (x[0] ^ x[i]) & low
            x0 = np.where(set_bit, x[0] ^ low, x[0] ^ swapped)
            x[i] = np.where(set_bit, x[i], x[i] ^ swapped) if i else x0
            x[0] = x0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> b & 1)
    return index


def hilbert_shards(rows: DataFrame, dimensions: Sequence[str], tie: Sequence[str], shards: int, bits: int = BITS) -> DataFrame:
    """Adds ``curve_index``, ``shard`` (equal runs of the curve, counts at most one apart) and ``slot``.

    ``tie`` orders rows of one cell and must tell apart rows that differ. Null values lie at the lowest level.
    Rows that are equal in all of ``tie`` are interchangeable. An empty table gives no rows.
    """
    rows = stage(rows, "metadata")
    levels = [level(c, level_cuts(rows, c, bits)) for c in dimensions]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    ordered = in_order(rows.withColumn("curve_index", index(*levels)), ["curve_index", *tie])
    n = F.lit(max(1, ordered.rows))
    shard = F.expr(f"place * {shards} div {max(1, ordered.rows)}")
    return (
        ordered.with_places("place")
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("place") - F.floor((F.col("shard") * n + (shards - 1)) / shards))
        .drop("place")
    )


def document_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Shards of documents by source, language and size, for rows in equal number.

    Size is the UTF-8 bytes of the text and 8; a null text has none and the checksum of the empty string.
    """
    meta = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "source",
        "lang",
    )
    return hilbert_shards(meta, ["source", "lang", "size"], ["doc_id", "text_crc32", "size", "source", "lang"], shards)


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write the documents, one folder for each shard, each file in the order of the curve.

    ``doc_id`` must be unique here. A shard is cut into files by ranges of its slots.
    """
    placed = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
