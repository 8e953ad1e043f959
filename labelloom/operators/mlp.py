"""A small network with one sigmoid output per label, trained where the rows lie.

Rows are dealt into a given number of shards by their id. In every epoch each shard runs its own seeded
mini-batches of Adam from the shared state, block by block, and the states are averaged by rows. The shards share
one batch size, so a step of all of them sees as many rows as one step of ordinary training would. More shards
train faster and average more; the number never follows from the size or the partitioning of the table, nor do blocks from the
size of Spark's batches, so the same rows give the same network.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, types as T

from labelloom.operators.linear import long_scores
from labelloom.operators.ranking import seeded_hash
from labelloom.operators.vectors import columns, sum_partials
from labelloom.operators.weights import row_weights

SHARDS = 8
#: Rows of a shard that are put in a random order together.
BLOCK_ROWS = 8192
#: Numbers of all shards' states together that the driver adds up itself: they follow the layers and the shards, not the table, and a
#: shuffle in every epoch takes longer than the epoch of a small one.
STATES = 1 << 20


@dataclass(frozen=True)
class Network:
    """Layer weights and the record of the training."""

    labels: tuple[str, ...]
    hidden: np.ndarray
    hidden_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray
    epochs: int
    final_loss: float
    reached_epoch_budget: bool


def _split(flat: np.ndarray, inputs: int, units: int, outputs: int):
    """Views of the four weight arrays in one flat vector."""
    sizes = [inputs * units, units, units * outputs, outputs]
    a, b, c, d = np.split(flat, np.cumsum(sizes)[:-1])
    return a.reshape(inputs, units), b, c.reshape(units, outputs), d


def _initial(inputs: int, units: int, outputs: int, seed: int) -> np.ndarray:
    """Uniform within the Glorot bounds: factor 6 for the rectified layer, 2 for the sigmoid one."""
    generator = np.random.default_rng(seed)
    bounds = [np.sqrt(6.0 / (inputs + units))] * 2 + [np.sqrt(2.0 / (units + outputs))] * 2
    sizes = [inputs * units, units, units * outputs, outputs]
    return np.concatenate([generator.uniform(-b, b, n) for b, n in zip(bounds, sizes)])


def forward(x: np.ndarray, hidden, hidden_bias, output, output_bias):
    """Hidden activations and output probabilities."""
    active = np.maximum(x @ hidden + hidden_bias, 0.0)
    return active, 1.0 / (1.0 + np.exp(-np.clip(active @ output + output_bias, -500, 500)))


def loss_and_gradient(flat, shape, x, y, weight, alpha):
    """Weighted mean over rows of the log loss summed over labels, with an L2 penalty on the weights."""
    hidden, hidden_bias, output, output_bias = _split(flat, *shape)
    active, probability = forward(x, hidden, hidden_bias, output, output_bias)
    safe = np.clip(probability, 1e-12, 1 - 1e-12)
    total = weight.sum()
    per_row = -(y * np.log(safe) + (1 - y) * np.log(1 - safe)).sum(axis=1)
    penalty = alpha * ((hidden * hidden).sum() + (output * output).sum()) / (2 * total)
    error = (probability - y) * weight[:, None] / total
    back = (error @ output.T) * (active > 0)
    gradient = np.concatenate(
        [
            (x.T @ back + alpha * hidden / total).ravel(),
            back.sum(axis=0),
            (active.T @ error + alpha * output / total).ravel(),
            error.sum(axis=0),
        ]
    )
    return weight @ per_row / total + penalty, gradient


def _adam(state, shape, x, y, weight, order, batch, rate, alpha):
    """Adam over the rows of one block in the given order; returns the new state and the summed loss."""
    flat, first, second, steps = state[0].copy(), state[1].copy(), state[2].copy(), state[3]
    summed = 0.0
    for start in range(0, len(order), batch):
        rows = order[start : start + batch]
        value, gradient = loss_and_gradient(flat, shape, x[rows], y[rows], weight[rows], alpha)
        steps += 1
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        pace = rate * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
        flat -= pace * first / (np.sqrt(second) + 1e-8)
        summed += value * len(rows)
    return (flat, first, second, steps), summed


def fit_mlp(
    dense: DataFrame,
    label_cols: Sequence[str],
    id_col: str,
    components: int,
    units: int = 64,
    alpha: float = 1e-4,
    rate: float = 1e-3,
    batch: int = 1024,
    max_epochs: int = 40,
    weight_cap: float = 8.0,
    tolerance: float = 1e-4,
    patience: int = 10,
    seed: int = 42,
    shards: int = SHARDS,
) -> Network:
    """Train on rows with dense ``features``; stops early when the loss stalls for over ``patience`` epochs."""
    labels = list(label_cols)
    shape = (components, units, len(labels))
    own_batch = max(1, batch // shards)
    data = (
        row_weights(dense, labels, weight_cap)
        .repartition(shards, id_col)
        .withColumn("_order", seeded_hash(seed, id_col))
        .sortWithinPartitions("_order")
        .select("features", "row_weight", *labels)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of ``BLOCK_ROWS`` rows, however many rows Spark hands over at once."""
        held: list[pa.RecordBatch] = []

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            x = rows.column("features").flatten().to_numpy().reshape(rows.num_rows, -1)
            arrays = x, columns(rows, labels), rows.column("row_weight").to_numpy()
            packed = [pa.array([pickle.dumps(array, protocol=5)], pa.binary()) for array in arrays]
            return pa.RecordBatch.from_arrays(packed, ["x", "y", "weight"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                rows = pa.concat_batches(held)
                whole = rows.num_rows - rows.num_rows % BLOCK_ROWS
                for start in range(0, whole, BLOCK_ROWS):
                    yield block(rows.slice(start, BLOCK_ROWS))
                held = [rows.slice(whole)]
        if sum(b.num_rows for b in held):
            yield block(pa.concat_batches(held))

    # Decoded once for all epochs.
    blocks = (
        data.mapInArrow(pack, "x binary, y binary, weight binary")
        .rdd.map(lambda row: tuple(pickle.loads(part) for part in row))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    flat = _initial(*shape, seed)
    state = (flat, np.zeros_like(flat), np.zeros_like(flat), 0)
    best, stalled, epoch, loss = np.inf, 0, 0, np.inf
    context = dense.sparkSession.sparkContext
    try:
        while epoch < max_epochs and stalled <= patience:
            shared = context.broadcast(state)
            number = epoch

            def partial(part: Iterator[tuple]):
                own, summed, count = shared.value, 0.0, 0
                chooser = np.random.default_rng([seed, number, TaskContext.get().partitionId()])
                for x, y, weight in part:
                    order = chooser.permutation(len(x))
                    own, loss = _adam(own, shape, x.astype(np.float64), y, weight, order, own_batch, rate, alpha)
                    summed, count = summed + loss, count + len(x)
                if not count:
                    return None
                return np.concatenate([*(array * count for array in own[:3]), [own[3] * count, summed, count]])

            total = sum_partials(blocks, partial, 3 * len(flat) + 3, direct=STATES)
            shared.unpersist()
            mean = total / total[-1]
            flat, first, second = np.split(mean[:-3], 3)
            state = (flat, first, second, int(round(mean[-3])))
            loss = mean[-2]
            stalled = stalled + 1 if loss > best - tolerance else 0
            best = min(best, loss)
            epoch += 1
    finally:
        blocks.unpersist()
    return Network(
        tuple(labels), *_split(state[0], *shape), epoch, float(loss), epoch >= max_epochs
    )


def score_multi(
    dense: DataFrame, network: Network, keep: Sequence[str], candidate: str, truth: bool = True
) -> DataFrame:
    """Long scores of every label from dense ``features``."""
    needed = [*keep, *(network.labels if truth else ())]
    layers = (network.hidden, network.hidden_bias, network.output, network.output_bias)
    shared = dense.sparkSession.sparkContext.broadcast(layers)
    schema = T.StructType(
        [dense.schema[c] for c in needed] + [T.StructField("outputs", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            outputs = forward(x, *shared.value)[1]
            ends = np.arange(0, outputs.size + 1, outputs.shape[1], dtype=np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(outputs.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in needed], made], [*needed, "outputs"])

    scored = dense.select(*needed, "features").mapInArrow(run, schema)
    return long_scores(scored, "outputs", network.labels, keep, candidate, truth)
