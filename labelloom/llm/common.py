"""Helpers shared by the operators: a distributed total order, and objects kept by a Python worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelloom.staging import stage

LONGS = ("_part", "_pos", "_before")
#: ASCII white space: blank and tab to carriage return; ``bytes.split`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Join keys that rows without a key are spread over.
SPREAD = 256


def null_safe_spread(key: str, row: str) -> Column:
    """0 where there is a key, else one of ``SPREAD`` numbers: a further join key, so that null keys do not meet in one task."""
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row), F.lit(SPREAD)) + 1).otherwise(0).cast("int")


def kept_by_worker(key: str, make: Callable[[], object]) -> object:
    """``make()``, kept for later tasks of the same Python process.

    Functions reach executors by value, so module variables do not outlive a task there.
    """
    kept = sys.modules.setdefault("_labelloom_kept", types.ModuleType("_labelloom_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]




class Ordered:
    """A table in a total order, written once: ``table`` has ``_part``, ``_pos`` (place inside the part) and
    ``_before`` (weight of the part's earlier rows); ``starts`` and ``weights`` have, for each part, the
    rows and the weight of all earlier parts.
    """

    def __init__(self, table: DataFrame, starts: np.ndarray, weights: np.ndarray, rows: int, weight: int):
        self.table, self.starts, self.weights, self.rows, self.weight = table, starts, weights, rows, weight

    def with_places(self, place: str, before: str | None = None) -> DataFrame:
        """Adds the global place (from 0) and, if asked for, the weight of all earlier rows."""
        starts, weights, names = self.starts, self.weights, [c for c in self.table.columns if c not in LONGS]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = batch.column("_part").to_numpy()
                columns = [batch.column(c) for c in names] + [pa.array(starts[part] + batch.column("_pos").to_numpy())]
                if before:
                    columns.append(pa.array(weights[part] + batch.column("_before").to_numpy()))
                yield pa.RecordBatch.from_arrays(columns, [*names, place] + [before] * bool(before))

        added = [T.StructField(c, T.LongType()) for c in [place] + [before] * bool(before)]
        return self.table.mapInArrow(add, T.StructType([*(self.table.schema[c] for c in names), *added]))


def in_order(df: DataFrame, order: Sequence[str], weight: str | None = None) -> Ordered:
    """Sort by range partitions and number the rows without any single-task step.

    ``order`` must tell apart all rows that differ. Each partition numbers its own rows; one count per
    partition goes to the driver. The numbered rows are written, as ranges are sampled and
    would not be cut alike a second time.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = len(df.columns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            w = np.zeros(n, np.int64) if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            before = total + np.cumsum(w) - w
            own = [np.full(n, part), np.arange(pos, pos + n), before]
            pos, total = pos + n, total + int(w.sum())
            columns = [batch.column(i) for i in range(width)] + [pa.array(x, pa.int64()) for x in own]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], *LONGS])

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in LONGS)])
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    table = stage(sorted_rows.mapInArrow(number, schema), "ordered")
    total = F.sum(weight) if weight else F.lit(0)
    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), total.cast("bigint").alias("w")).collect()
    size = max((r["_part"] for r in counts), default=-1) + 1
    rows, weights = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in counts:
        rows[r["_part"]], weights[r["_part"]] = r["n"], r["w"]
    return Ordered(table, np.cumsum(rows) - rows, np.cumsum(weights) - weights, int(rows.sum()), int(weights.sum()))


def packed(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others in a struct ``rest``, so that their names meet no others."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return df.select(*own, F.struct(*others, F.lit(0).alias("_" * (1 + max(map(len, df.columns))))).alias("rest"))


def unpacked(df: DataFrame, columns: Sequence[str], *own: str) -> DataFrame:
    """The columns in their order again."""
    return df.select(*[c if c in own else F.col("rest").getField(c).alias(c) for c in columns])
