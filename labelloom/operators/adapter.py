"""Truncated SVD and standard scaling of encoded rows, the input of the network.

The SVD is a randomised subspace iteration on the smaller side of the matrix. With fewer features than rows, the basis is of
features by components. With fewer rows than features, the entries are shuffled once into transposed rows, ranges of features,
and the basis is of rows by components; the directions follow in a last pass.

A basis and the directions live outside the driver in pieces of bounded size, written after every pass. In a pass every
partition of the rows is given all pieces by a shuffle, and its sums are added up piece by piece, so there are at most ``PARTS``
such partitions. A task works on as many columns of a basis as make ``SLICE`` numbers, so its memory does not follow the features or
rows times all components. The driver receives products of components by components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, types as T

from labelloom.operators import vectors as vec
from labelloom.operators.vectors import cut_rows, full_block, row_blocks, rows_of, sparse_rows, sum_partials, turned_blocks
from labelloom.staging import LARGE_RECORDS, discard, fresh_path, stage

#: Rows of a piece of a basis, and the most partitions that a whole basis is sent to.
PIECE, PARTS = 8192, 8
#: Numbers of a basis that a task holds, and rows for which a further task is given all directions.
SLICE, ROWS_PER_COPY = 1 << 24, 8192
#: The share of the rows that a feature must have to be multiplied as a dense column: an entry by itself takes as long as some dozen
#: cells of a dense product.
DENSE_SHARE = 0.04
SMALLEST = 8


@dataclass(frozen=True)
class Adapter:
    """Directions, and mean and deviation of the training rows on them.

    The directions are a written table of pieces: ``features`` and their ``loadings``, up to ``signs``.
    """

    pieces: DataFrame
    features: int
    signs: np.ndarray
    singular_values: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    explained_variance: float

    @property
    def components(self) -> int:
        return len(self.mean)

    @property
    def directions(self) -> np.ndarray:
        """Features by components, gathered on the driver: for a look at small ones."""
        whole = np.zeros((self.features, self.components))
        for features, loadings in _pieces(self.pieces).collect():
            whole[features] = loadings * self.signs
        return whole


def _beside(pieces: RDD, data: RDD) -> RDD:
    """The partitions of ``data``, each after a copy of all ``pieces``; both are dealt by their integer keys."""
    parts = data.getNumPartitions()
    return pieces.flatMap(lambda piece: [(part, piece) for part in range(parts)]).partitionBy(parts, int).union(data)


def _dealt(items: RDD, parts: int) -> RDD:
    """Items with keys, in turn over ``parts`` partitions."""
    numbered = items.mapPartitionsWithIndex(lambda part, some: ((part + at, item) for at, item in enumerate(some)))
    return numbered.partitionBy(parts, int)


def _table(spark: SparkSession, pieces: RDD) -> DataFrame:
    packed = pieces.map(lambda pair: tuple(pickle.dumps(part, protocol=5) for part in pair))
    return spark.createDataFrame(packed, "features binary, loadings binary")


def _pieces(table: DataFrame) -> RDD:
    return table.rdd.map(lambda row: tuple(pickle.loads(part) for part in row))


class _Written:
    """Bases of one fit, of which the last two are kept: written, so that neither their lineage nor their shuffles stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, pieces: RDD) -> RDD:
        path = fresh_path(self.spark, "basis")
        parts = pieces.getNumPartitions()
        table = _table(self.spark, pieces)
        table.write.options(**LARGE_RECORDS).parquet(path)
        self.paths.append(path)
        self.discard(2)
        # The shuffle files of passes that are done go when the driver's JVM collects its garbage.
        self.spark._jvm.System.gc()
        return _pieces(self.spark.read.schema(table.schema).parquet(path)).partitionBy(parts, int)

    def discard(self, but: int = 0) -> None:
        while len(self.paths) > but:
            discard(self.spark, self.paths.pop(0))


@contextmanager
def _bases(spark: SparkSession) -> Iterator[_Written]:
    written = _Written(spark)
    try:
        yield written
    finally:
        written.discard()


def _random(data: RDD, size: int, width: int, seed: int) -> RDD:
    """Pieces of one normal matrix; each task draws it from the start up to its own."""

    def draw(number: int) -> tuple[int, np.ndarray]:
        generator = np.random.default_rng(seed)
        for _ in range(number):
            generator.standard_normal((PIECE, width))
        return number, generator.standard_normal((min(PIECE, size - number * PIECE), width))

    count = -(-size // PIECE)
    return data.context.parallelize(range(count), min(count, PARTS)).map(draw).partitionBy(min(count, PARTS), int)


def _orthonormal(pieces: RDD) -> RDD:
    """Orthonormal columns, in double precision, with the same span: Cholesky factors of the Gram matrix, twice for full precision.

    That is a few products; a QR decomposition, of the pieces and then of their factors, takes over for a span that is not of
    full rank.
    """
    pieces = given = pieces.mapValues(lambda rows: rows.astype(np.float64))
    try:
        for _ in range(2):
            gram = pieces.map(lambda pair: pair[1].T @ pair[1]).reduce(np.add)
            turn = np.linalg.inv(np.linalg.cholesky(gram)).T
            pieces = pieces.mapValues(lambda rows, turn=turn: rows @ turn)
        return pieces
    except np.linalg.LinAlgError:
        factors = dict(given.mapValues(lambda rows: np.linalg.qr(rows, mode="r")).collect())
        ends = np.cumsum([len(factors[k]) for k in sorted(factors)])[:-1]
        second = np.split(np.linalg.qr(np.concatenate([factors[k] for k in sorted(factors)]))[0], ends)
        return given.map(lambda pair: (pair[0], np.linalg.qr(pair[1])[0] @ second[pair[0]]), preservesPartitioning=True)


def _products(lengths: np.ndarray, index: np.ndarray, value: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sparse rows times dense columns, each row by the lines of the columns that it uses; in double precision if the values are."""
    out, start = np.zeros((len(lengths), columns.shape[1]), np.result_type(value, columns)), 0
    for row, end in enumerate(np.cumsum(lengths).tolist()):
        if end > start:
            np.dot(value[start:end], columns.take(index[start:end], axis=0), out=out[row])
        start = end
    return out


def _turned_parts(block: tuple, rows: int) -> Iterator[tuple]:
    """A turned block as dense blocks of its frequent features, ``(features, matrix)``, and runs of the others, ``(features, lengths,
    rows, values)``, of about ``BLOCK_ENTRIES`` entries."""
    lengths, row, value, _ = block
    ends = np.cumsum(lengths, dtype=np.int64)
    frequent = lengths >= DENSE_SHARE * rows
    dense = np.flatnonzero(frequent)
    size = max(1, vec.DENSE // max(rows, 1))
    for start in range(0, len(dense), size):
        some = dense[start : start + size]
        matrix = np.zeros((len(some), rows), np.float32)
        for at, feature in enumerate(some.tolist()):
            held = slice(ends[feature] - lengths[feature], ends[feature])
            matrix[at, row[held]] = value[held]
        yield some, matrix
    rare = np.repeat(~frequent, lengths)
    lengths, row, value, features = lengths[~frequent], row[rare], value[rare], np.flatnonzero(~frequent)
    ends, start, before = np.cumsum(lengths, dtype=np.int64), 0, 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, before + vec.BLOCK_ENTRIES, side="right")))
        held = slice(before, ends[stop - 1])
        yield features[start:stop], lengths[start:stop], row[held], value[held].astype(np.float32, copy=False)
        start, before = stop, ends[stop - 1]


def _add_turned(block: tuple, columns: np.ndarray, total: np.ndarray) -> None:
    """Add ``X X' columns`` of a block of transposed rows."""
    for part in _turned_parts(block, len(columns)):
        if len(part) == 2:
            total += part[1].T @ (part[1] @ columns)
            continue
        _, lengths, row, value = part
        through = _products(lengths, row, value, columns)
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row, minlength=len(columns))
        used = np.flatnonzero(counts)
        total[used] += _products(counts[used], np.repeat(np.arange(len(lengths)), lengths)[order], value[order], through)


def _normal_product(data: RDD, basis: RDD, size: int, width: int, turned: bool) -> RDD:
    """``X'(X basis)`` in pieces; products in single precision, a partition's sums in double. A task has a range of the columns."""
    count = -(-size // PIECE)
    cuts = np.linspace(0, width, -(-size * width // SLICE) + 1).astype(int).tolist()

    def over(low: int, high: int) -> RDD:
        def product(part: Iterator[tuple]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
            columns, total = np.zeros((size, high - low), np.float32), None
            for _, item in part:
                if len(item) == 2:
                    start = item[0] * PIECE
                    columns[start : start + PIECE] = item[1]
                    continue
                total = np.zeros(columns.shape) if total is None else total
                if turned:
                    _add_turned(item, columns, total)
                    continue
                for used, dense in rows_of(item).blocks(kind=np.float32):
                    total[used] += dense.T @ (dense @ columns[used])
            if total is not None:
                for number in range(count):
                    yield number, (low, total[number * PIECE : (number + 1) * PIECE].astype(np.float32))

        return _beside(basis.mapValues(lambda rows: rows[:, low:high].astype(np.float32)), data).mapPartitions(product)

    def added(part: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, dict[int, np.ndarray]] = {}
        for number, (low, rows) in part:
            known = sums.setdefault(number, {})
            known[low] = known[low] + rows if low in known else rows
        for number, known in sums.items():
            yield number, np.hstack([known[low] for low in sorted(known)])

    made = data.context.union([over(low, high) for low, high in zip(cuts, cuts[1:])])
    return made.partitionBy(min(count, PARTS), int).mapPartitions(added, preservesPartitioning=True)


def _moments(row_data: RDD, features: int):
    """Column sums, sum of squares and number of rows."""

    def partial(part: Iterator[tuple]):
        total = np.zeros(features + 2)
        for block in map(full_block, part):
            rows = rows_of(block)
            total[:-2] += np.bincount(rows.index, weights=rows.value, minlength=features)
            total[-2] += rows.value @ rows.value
            total[-1] += rows.count
        return total

    summed = sum_partials(row_data, partial, features + 2)
    return summed[:-2], summed[-2], summed[-1]


def _leading(
    data: RDD, size: int, width: int, iterations: int, seed: int, written: _Written, turned: bool
) -> tuple[RDD, np.ndarray]:
    """Leading eigenvectors, in pieces, and eigenvalues of ``X'X`` for rows of ``size`` columns, largest first."""
    basis = _orthonormal(written.keep(_random(data, size, width, seed)))
    for _ in range(iterations + 1):
        basis = _orthonormal(written.keep(_normal_product(data, basis, size, width, turned)))

    def inner(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        rows: dict[int, np.ndarray] = {}
        for number, values in part:
            if number in rows:
                yield rows.pop(number).T @ values
            else:
                rows[number] = values

    spread, turn = np.linalg.eigh(basis.union(_normal_product(data, basis, size, width, turned)).mapPartitions(inner).reduce(np.add))
    turn = turn[:, ::-1]
    return basis.mapValues(lambda rows: rows @ turn), np.maximum(spread[::-1], 0.0)


def _right_side(turned: RDD, left: RDD, singular: np.ndarray, rows: int) -> RDD:
    """Directions over the features from those over the rows: ``X' left / singular``, each range where it lies."""
    kept = len(singular)

    def project(part: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        columns = np.zeros((rows, kept), np.float32)
        for _, item in part:
            if len(item) == 2:
                columns[item[0] * PIECE : (item[0] + 1) * PIECE] = item[1]
            else:
                loadings = np.zeros((len(item[3]), kept), np.float32)
                for used, *part in _turned_parts(item, rows):
                    part[-1] = part[-1].astype(np.float64)
                    loadings[used] = part[0] @ columns if len(part) == 1 else _products(*part, columns)
                for start in range(0, len(loadings), PIECE):
                    yield item[3][start : start + PIECE], loadings[start : start + PIECE]

    scaled = left.mapValues(lambda some: (some[:, :kept] / np.maximum(singular, 1e-300)).astype(np.float32))
    return _beside(scaled, turned).mapPartitions(project)


def fit_adapter(
    vectors: DataFrame,
    features: int,
    rows: int,
    components: int = 192,
    iterations: int = 4,
    seed: int = 42,
    oversample: int = 10,
) -> Adapter:
    """Uncentred truncated SVD of the rows, then mean and population deviation per component."""
    kept = min(components, rows - 1, features - 1)
    if kept < SMALLEST:
        raise ValueError(f"Too few rows or features for {SMALLEST} components.")
    width = min(kept + oversample, rows, features)
    spark = vectors.sparkSession
    with row_blocks(vectors, [], rows, written=rows < features, short=rows < features) as row_data, _bases(spark) as written:
        sums, squares, count = _moments(row_data, features)
        blocks = turned_blocks(row_data, features) if rows < features else row_data
        data = _dealt(blocks, min(PARTS, blocks.getNumPartitions())).persist(StorageLevel.MEMORY_AND_DISK)
        data.count()
        row_data.unpersist()
        if rows < features:
            left, energy = _leading(data, rows, width, iterations, seed, written, turned=True)
            directions = _right_side(data, left, np.sqrt(energy[:kept]), rows)
        else:
            right, energy = _leading(data, features, width, iterations, seed, written, turned=False)
            directions = right.map(lambda pair: (np.arange(len(pair[1])) + pair[0] * PIECE, pair[1][:, :kept]))
        pieces = stage(_table(spark, directions), "directions", large=True)
        data.unpersist()
    energy = energy[:kept]

    def told(piece: tuple) -> tuple[np.ndarray, np.ndarray]:
        """A piece's share of the mean, and its loading of largest size per component."""
        index, loadings = piece
        return (sums[index] / count) @ loadings, loadings[np.argmax(np.abs(loadings), axis=0), np.arange(kept)]

    def joined(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
        return one[0] + other[0], np.where(np.abs(one[1]) >= np.abs(other[1]), one[1], other[1])

    mean, largest = _pieces(pieces).map(told).reduce(joined)
    # Signs are arbitrary: the largest loading is made positive.
    signs = np.sign(largest)
    mean = mean * signs
    variance = np.maximum(energy / count - mean * mean, 0.0)
    total_variance = squares / count - (sums / count) @ (sums / count)
    deviation = np.sqrt(variance)
    deviation[deviation < 1e-12] = 1.0
    return Adapter(pieces, features, signs, np.sqrt(energy), mean, deviation, float(variance.sum() / total_variance))


def apply_adapter(vectors: DataFrame, adapter: Adapter, keep: Sequence[str], rows: int | None = None) -> DataFrame:
    """Rows with dense scaled ``features``.

    The rows are dealt to ``PARTS`` partitions, or fewer if their number is given and small, each of which gets the directions,
    features times components in single precision, at most 230 MB at the default limits.
    """
    features, components = adapter.features, adapter.components
    signs, mean, deviation = adapter.signs, adapter.mean, adapter.deviation
    schema = T.StructType(
        [vectors.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.FloatType()))]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut_rows(whole):
                yield pa.RecordBatch.from_arrays([pa.array([_written(batch)], pa.binary())], ["rows"])

    def project(part: Iterator[tuple]) -> Iterator[tuple[bytes]]:
        directions = np.zeros((features, components), np.float32)
        for _, item in part:
            if len(item) == 2:
                directions[item[0]] = item[1]
                continue
            batch = pa.ipc.open_stream(item[0]).read_next_batch()
            given = sparse_rows(batch)
            lengths = np.bincount(given.row, minlength=given.count)
            reduced = _products(lengths, given.index, given.value, directions) * signs
            scaled = ((reduced - mean) / deviation).astype(np.float32)
            ends = np.arange(0, scaled.size + 1, scaled.shape[1], dtype=np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(scaled.ravel()))
            whole = pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], [*keep, "features"])
            yield (_written(whole),)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                yield pa.ipc.open_stream(rows.as_buffer()).read_next_batch()

    packed = vectors.select(*dict.fromkeys([*keep, "indices", "values"])).mapInArrow(pack, "rows binary")
    data = _dealt(packed.rdd.map(tuple), PARTS if rows is None else max(1, min(PARTS, -(-rows // ROWS_PER_COPY))))
    reduced = _beside(_pieces(adapter.pieces), data).mapPartitions(project)
    return vectors.sparkSession.createDataFrame(reduced, "rows binary").mapInArrow(unpack, schema)


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()
