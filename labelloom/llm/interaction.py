"""How filters overlap when applied in every order, from sorted posting lists of failing rows.

A row has a number; per part and range of numbers, each filter keeps the sorted list of the numbers that fail it. Whatever an
order of filters does follows from sizes of unions and differences of these lists, which galloping merges find range by range;
sizes of ranges add up. A range holds at most ``RANGE`` numbers, so a hot part is many ranges and no list outgrows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.llm.common import null_safe_spread
from labelloom.operators.ranking import skew_safe_lookup
from labelloom.staging import stage

#: Row numbers of a range, and ids that a merge compares at once.
RANGE, BLOCK = 1 << 16, 1024
MOST_FILTERS = 7
FILTERS = ("A", "B", "C", "D", "E")
#: Fewer words than these fail A; a share of distinct words under these percent fails B; a share of A-Z over these fails C.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
CAPITALS, MARKUP = bytes(range(65, 91)), b"#$%&*|"
CONTINUATION = bytes(range(128, 192))


def gallop(ids: np.ndarray, start: int, bound: int) -> int:
    """First place from ``start`` on whose id is not below ``bound``: steps double until one passes it, the last is bisected."""
    step = 1
    while start + step < len(ids) and ids[start + step] < bound:
        step *= 2
    low = start + step // 2
    return low + int(np.searchsorted(ids[low : start + step + 1], bound)) if start < len(ids) else start


def union(lists: Sequence[np.ndarray]) -> np.ndarray:
    """Merge of sorted lists: the longest is walked in blocks, the others gallop to each block's end."""
    lists = [ids for ids in lists if len(ids)]
    if not lists:
        return np.empty(0, np.int64)
    places, out = [0] * len(lists), []
    for bound in [*max(lists, key=len)[BLOCK::BLOCK], np.iinfo(np.int64).max]:
        ends = [gallop(ids, place, bound) for ids, place in zip(lists, places)]
        out.append(np.unique(np.concatenate([ids[a:b] for ids, a, b in zip(lists, places, ends)])))
        places = ends
    return np.concatenate(out)


def without(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sorted ``ids`` that are not in the sorted ``other``, which gallops along."""
    if not len(ids) or not len(other):
        return ids
    kept, place = [], 0
    for begin in range(0, len(ids), BLOCK):
        block = ids[begin : begin + BLOCK]
        place = gallop(other, place, block[0])
        end = gallop(other, place, block[-1] + 1)
        near = other[place:end]
        if len(near):
            at = np.minimum(np.searchsorted(near, block), len(near) - 1)
            block = block[near[at] != block]
        kept.append(block)
        place = end
    return np.concatenate(kept)


def overlaps(fails: Sequence[np.ndarray], marked: Sequence[np.ndarray]) -> Iterator[tuple[int, ...]]:
    """``(filter, earlier filters as bits, fails, removed, redundant, out, unique, removed and marked ...)``."""
    n = len(fails)
    for earlier in range(1 << n):
        gone = union([fails[g] for g in range(n) if earlier >> g & 1])
        for f in range(n):
            if not earlier >> f & 1:
                removed = without(fails[f], gone)
                last = len(removed) if earlier | 1 << f == (1 << n) - 1 else 0
                lost = [len(removed) - len(without(removed, m)) for m in marked]
                yield (f, earlier, len(fails[f]), len(removed), len(fails[f]) - len(removed), len(gone) + len(removed), last, *lost)


def filter_orders(filters: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """``(order, step, filter, earlier filters as bits)`` of every order of the filters."""
    out = []
    for order in permutations(range(len(filters))):
        earlier = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(filters[g] for g in order), step, f, earlier))
            earlier |= 1 << f
    return out


def interactions(rows: DataFrame, part: str, filters: Sequence[str], marked: Sequence[str] = ()) -> DataFrame:
    """Per part, order of the filters and step: ``kept, removed, redundant, unique_fails, <mark>_lost ..., shapley``.

    ``filters`` are boolean columns, true where a row fails; ``marked`` are boolean columns whose removed rows are counted. Nulls
    count as false, a null part as the empty string; repeated rows count each. Other columns are ignored. An empty table gives no
    rows; a part without any failure gives zeros. At most ``MOST_FILTERS`` filters, as all their orders are returned.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"Between 1 and {MOST_FILTERS} filters can be audited, not {len(filters)}.")
    lists = [*filters, *marked]
    own = [F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(f"_{i}") for i, c in enumerate(lists)]
    table = stage(rows.select(F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), *own), "failures")
    numbered = table.withColumn("_id", F.monotonically_increasing_id())
    postings = numbered.groupBy("part", F.expr(f"_id div {RANGE}").alias("_range")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.array_sort(F.collect_list(F.when(F.col(f"_{i}"), F.col("_id")))).alias(f"_{i}") for i in range(len(lists))]
    )
    n = len(filters)
    names = ["_f", "_earlier", "_fails", "removed", "redundant", "_out", "unique_fails", *(f"{m}_lost" for m in marked)]
    sums = ["_rows", *names[2:]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                ids = [batch.column(2 + i)[at].values.to_numpy() for i in range(len(lists))]
                out += [(batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), *found) for found in overlaps(ids[:n], ids[n:])]
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] + [pa.int64()] * (1 + len(names)))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "_rows", *names])

    long = ", ".join(f"`{c}` long" for c in ["_rows", *names])
    found = postings.drop("_range").mapInArrow(measure, f"part string, {long}")
    found = stage(found.groupBy("part", "_f", "_earlier").agg(*[F.sum(f"`{c}`").alias(c) for c in sums]), "overlaps")
    orders = rows.sparkSession.createDataFrame(filter_orders(filters), "filter_order string, step int, _f long, _earlier long")
    everywhere = Window.partitionBy("part", "_f")
    unique = F.max("unique_fails").over(everywhere)
    return found.join(F.broadcast(orders), ["_f", "_earlier"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("_rows") - F.col("_out")).alias("kept"),
        "removed",
        "redundant",
        unique.alias("unique_fails"),
        *[F.col(f"`{m}_lost`") for m in marked],
        F.sum("removed").over(everywhere).alias("shapley"),
    )


def text_failures(docs: DataFrame) -> DataFrame:
    """``row, doc_id, part, A, B, C, D, E`` of every document; true where it fails.

    A: under 200 words; B: under half of them distinct; C: over two in a hundred code points are A-Z; D: holds one of ``#$%&*|``;
    E: equals the text of a smaller doc_id. A null text is empty; a null doc_id is smaller than none and larger than none. Equal
    texts are told by their SHA-256. Repeated rows do not fail E for each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for value in batch.column(2):
                text = value.as_py() or b""
                words = text.split()
                distinct, points = len(set(words)), len(text.translate(None, CONTINUATION))
                capitals = len(text) - len(text.translate(None, CAPITALS))
                out.append((
                    len(words) < LEAST_WORDS,
                    100 * distinct < DISTINCT_PERCENT * len(words),
                    100 * capitals > CAPITALS_PERCENT * points,
                    len(text.translate(None, MARKUP)) < len(text),
                    hashlib.sha256(text).digest(),
                ))
            if out:
                numbers = pa.array(np.arange(row, row + len(out)))
                row += len(out)
                told = [pa.array(c, t) for c, t in zip(zip(*out), [pa.bool_()] * 4 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays([numbers, batch.column(0), batch.column(1), *told], names)

    names = ["row", "doc_id", "part", "A", "B", "C", "D", "digest"]
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary"))
    read = stage(texts.mapInArrow(run, "row long, doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"), "texts")
    copies = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    told = skew_safe_lookup(read, copies, ["digest"], ["first"], "copies", "row")
    return told.select("row", "doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five text filters per source, with the good and the toxic documents each step loses.

    A document is good, or toxic, if any of its rows in ``labels`` has quality 1, or toxic 1; null labels and null ids say nothing.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = text_failures(docs).withColumn("_spread", null_safe_spread("doc_id", "row"))
    told = rows.join(said.withColumn("_spread", F.lit(0)), ["doc_id", "_spread"], "left")
    return interactions(told, "part", FILTERS, ("good", "toxic"))
