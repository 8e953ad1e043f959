"""Passes over encoded rows: every partition sends one partial sum of bounded size."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from labelloom.staging import stage

#: Numbers that partial sums may have together to be sent to the driver as they are, and numbers in a range. A fit sums dozens of
#: times, so the first stays small.
DIRECT, RANGE = 1 << 18, 1 << 16
ROWS_PER_SUM = 512
#: Numbers of a dense block.
DENSE = 1 << 22
#: Entries of a block of sparse rows, unless one row has more.
BLOCK_ENTRIES = 1 << 20
PACKED = ["lengths", "indices", "values", "labels"]


@dataclass(frozen=True)
class Rows:
    """The sparse rows of one Arrow batch: row number, feature index and value per entry."""

    count: int
    row: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def times(self, column: np.ndarray) -> np.ndarray:
        """Product of the rows with one dense column."""
        return np.bincount(self.row, weights=self.value * column[self.index], minlength=self.count)

    def transposed_times(self, column: np.ndarray, features: int) -> np.ndarray:
        """Product of the transposed rows with one value per row."""
        return np.bincount(self.index, weights=self.value * column[self.row], minlength=features)

    def blocks(self, size: int = 256, kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dense blocks of up to ``size`` rows over the features they use: (features, matrix).

        Products with many columns run faster on such a block than entry by entry. Rows that use many features come in smaller
        blocks, so that a block holds about ``DENSE`` numbers at most.
        """
        start = 0
        while start < self.count:
            rows = min(size, self.count - start)
            while True:
                low, high = np.searchsorted(self.row, [start, start + rows])
                if rows == 1 or rows * min(high - low, self.index.max(initial=0) + 1) <= DENSE:
                    break
                rows //= 2
            used, local = np.unique(self.index[low:high], return_inverse=True)
            dense = np.zeros((rows, len(used)), kind)
            dense[self.row[low:high] - start, local] = self.value[low:high]
            yield used, dense
            start += rows


def sparse_rows(batch: pa.RecordBatch) -> Rows:
    """Read the ``indices`` and ``values`` columns of a batch."""
    indices, values = batch.column("indices"), batch.column("values")
    return Rows(
        batch.num_rows,
        np.repeat(np.arange(batch.num_rows), indices.value_lengths().to_numpy(zero_copy_only=False)),
        indices.flatten().to_numpy(),
        values.flatten().to_numpy().astype(np.float64),
    )


def columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """The named numeric columns of a batch as a matrix."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float64)


def run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; an empty one has none."""
    sums, held = np.zeros(len(lengths)), lengths > 0
    if len(values):
        sums[held] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[held])
    return sums


def cut_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of ``BLOCK_ENTRIES`` entries or a single row, so that what is made of one does not follow the length of rows."""
    ends = np.cumsum(batch.column("indices").value_lengths().to_numpy(zero_copy_only=False))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_ENTRIES, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, ends[stop - 1]


def alike_in_rows(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Values as one column with a value for each row, if those of a row are all the same; else as they are."""
    first = np.zeros(len(lengths), values.dtype)
    first[lengths > 0] = values[(np.cumsum(lengths) - lengths)[lengths > 0]]
    return first[:, None] if np.array_equal(np.repeat(first, lengths), values) else values


def short_indices(indices: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row lengths and indices; if they are sorted as far as that goes, the entries of each row by 65,536 features and the low 16 bits."""
    ranges = (int(indices.max(initial=0)) >> 16) + 1
    place = np.repeat(np.arange(len(lengths)) * ranges, lengths) + (indices >> 16)
    if np.any(place[1:] < place[:-1]):
        return lengths, indices
    return np.bincount(place, minlength=len(lengths) * ranges).reshape(-1, ranges).astype(np.int32), indices.astype(np.uint16)


def full_block(block: tuple) -> tuple:
    """A block with row lengths and whole indices; its values stay a column if they are."""
    lengths, index, value, labels = block
    if lengths.ndim == 2:
        rows, ranges = lengths.shape
        index = index + np.repeat(np.tile(np.arange(ranges) << 16, rows), lengths.ravel())
        lengths = lengths.sum(axis=1)
    return lengths, index.astype(np.intp, copy=False), value, labels


@contextmanager
def row_blocks(
    vectors: DataFrame, labels: Sequence[str], rows: int, written: bool = False, most: int | None = None, short: bool = False
) -> Iterator[RDD]:
    """The rows as persisted numpy blocks ``(row lengths, indices, values, labels)``, some per Arrow batch.

    A fit passes over the rows dozens of times. Decoded once, a pass is a plain job over blocks; as
    a query it would be planned, and its arrays converted, every time. Few rows are gathered in few
    partitions, since a partition answers with a sum of full size however few rows it has, and many in ``most`` at most. With ``written``
    the blocks are staged first, and so keep their order when they have to be read again. ``short`` blocks are smaller, as
    ``short_indices`` and ``alike_in_rows`` make them, and read by ``full_block``.
    """
    names = list(labels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_rows(whole):
                indices, values = batch.column("indices"), batch.column("values")
                lengths, of_entries = indices.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), values.flatten().to_numpy()
                index = indices.flatten().to_numpy().astype(np.int32)
                arrays = (
                    *(short_indices(index, lengths) if short else (lengths, index)),
                    alike_in_rows(of_entries, lengths) if short else of_entries,
                    columns(batch, names) if names else np.zeros(0),
                )
                packed = [pa.array([pickle.dumps(array, protocol=5)], pa.binary()) for array in arrays]
                yield pa.RecordBatch.from_arrays(packed, PACKED)

    schema = StructType([StructField(name, BinaryType()) for name in PACKED])
    gathered = vectors.select("indices", "values", *names).coalesce(max(1, min(rows // ROWS_PER_SUM, most or rows)))
    packed = gathered.mapInArrow(pack, schema)
    packed = stage(packed, "blocks", large=True) if written else packed
    blocks = packed.rdd.map(lambda row: tuple(pickle.loads(part) for part in row))
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield blocks
    finally:
        blocks.unpersist()


def turned_blocks(blocks: RDD, features: int) -> RDD:
    """The transposed rows: blocks ``(lengths, rows, values, features)``, one row for every feature in use.

    Features are cut into as many ranges as there are partitions; an entry is shuffled once, with its row's number. ``blocks``
    must give the same rows in the same order whenever they are read.
    """
    ranges = blocks.getNumPartitions()
    width = -(-features // ranges)
    numbered = blocks.zipWithIndex()
    counts = dict(numbered.map(lambda pair: (pair[1], len(pair[0][0]))).collect())  # one number per block
    firsts = np.cumsum([0, *(counts[k] for k in sorted(counts))])

    def cut(pair):
        block, number = pair
        lengths, index, value, _ = full_block(block)
        order = np.argsort(index, kind="stable")
        row, index = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order], index[order]
        alike = value.ndim == 2
        value = value if alike else value[order]
        ends = np.searchsorted(index, np.arange(0, (ranges + 1) * width, width))
        for at, (low, high) in enumerate(zip(ends, ends[1:])):
            if low < high:
                used, counts = np.unique(index[low:high], return_counts=True)
                yield at, (number, used.astype(np.int32), counts.astype(np.int32), row[low:high], value if alike else value[low:high])

    def gather(group):
        pieces = sorted(group[1], key=lambda piece: piece[0])
        index = np.concatenate([np.repeat(used, counts) for _, used, counts, _, _ in pieces])
        # In the order of the blocks, so a stable sort leaves the rows of a feature in order.
        order = np.argsort(index, kind="stable")
        row = np.concatenate([row + np.int32(firsts[number]) for number, _, _, row, _ in pieces])[order]
        value = np.concatenate([value[row, 0] if value.ndim == 2 else value for _, _, _, row, value in pieces])[order]
        used, lengths = np.unique(index, return_counts=True)
        return lengths.astype(np.int32), row, value, used

    return numbered.flatMap(cut).groupByKey(ranges).map(gather)


def rows_of(block: tuple) -> Rows:
    """The sparse rows of a block."""
    lengths, index, value, _ = block
    value = np.repeat(value[:, 0], lengths) if value.ndim == 2 else value
    return Rows(len(lengths), np.repeat(np.arange(len(lengths)), lengths), index, value.astype(np.float64))


def sum_partials(
    blocks: RDD, partial: Callable[[Iterator], np.ndarray | None], size: int, direct: int | None = None
) -> np.ndarray:
    """Sum over partitions of the array of ``size`` numbers that ``partial`` makes from each partition's blocks.

    The driver receives all partial sums while they are small together (``direct`` numbers, ``DIRECT`` if not given), without their
    zeros if these are many. Beyond that they are cut into
    ranges and added up by range on the executors, so that it receives a single sum however many partitions
    there are.
    """

    def run(part):
        total = partial(part)
        if total is not None:
            yield total.ravel()

    def ranges(part):
        for flat in run(part):
            for start in range(0, size, RANGE):
                yield start, flat[start : start + RANGE]

    def short(part):
        for flat in run(part):
            at = np.flatnonzero(flat)
            yield (at.astype(np.int32), flat[at]) if 2 * len(at) < len(flat) else (None, flat)

    partitions, whole, found = blocks.getNumPartitions(), np.zeros(size), False
    if partitions == 1 or partitions * size <= (DIRECT if direct is None else direct):
        parts = blocks.mapPartitions(short).collect()
    else:
        summed = blocks.mapPartitions(ranges).reduceByKey(np.add, min(partitions, -(-size // RANGE))).collect()
        parts = [(slice(start, start + RANGE), values) for start, values in summed]
    for at, values in parts:
        found = True
        if at is None:
            whole += values
        else:
            whole[at] += values
    if not found:
        raise ValueError("There are no rows.")
    return whole
