"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are cut into groups of correlated bits. If two fingerprints differ in at most ``distance``
bits and the thresholds ``t`` of the groups satisfy ``sum(t + 1) = distance + 1``, they differ in at most ``t``
bits in some group. A dynamic program shares out the thresholds, and picks the number of groups, by
estimated cost. Every fingerprint is put down under its own bits of each group and those within the
threshold, and the members of each key are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import kept_by_worker, packed, unpacked
from labelloom.llm.components import connect
from labelloom.staging import stage

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a key that one task compares at once; larger keys are cut into blocks.
BLOCK = 4096
#: Runs up to this length are compared by shifts over the whole batch.
SHORT = 16
#: What writing and sorting one key costs, in comparisons.
ROW_COST = 200


def fingerprint(words: Sequence[bytes], width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a word sequence: a bit is 1 if set in over half the shingles' hashes."""
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _bit_table()
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _bit_table() -> np.ndarray:
    return kept_by_worker("bits of bytes", lambda: np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint of the lower-cased (A-Z) words of every text, as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint((t or b"").lower().split(), width) for t in (s.as_py() for s in batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits in how many both are set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float64)
            both, n = both + bits.T @ bits, n + len(bits)
        cells = pa.array(range(-1, BITS * BITS), pa.int32())
        yield pa.RecordBatch.from_arrays([cells, pa.array(np.append(n, both.ravel()).astype(np.int64))], ["cell", "n"])

    sums = prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for r in sums:
        out[r["cell"] + 1] = r["n"]
    return int(out[0]), out[1:].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, groups: int) -> list[list[int]]:
    """Cut the bits into groups of about equal width, each grown by the bit most correlated with it."""
    p = both.diagonal() / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = (BITS * (g + 1)) // groups - (BITS * g) // groups
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (corr[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def masks(bits: Sequence[int], threshold: int) -> list[int]:
    """Signed 64-bit masks of at most ``threshold`` of the bits."""
    return [int(np.array(sum(1 << b for b in c), np.uint64).view(np.int64)) for t in range(threshold + 1) for c in combinations(bits, t)]


def share_thresholds(costs: Sequence[Sequence[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1: group unused) with ``sum(t + 1) = distance + 1`` of least cost; ``costs[g][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for units in range(distance + 2 - spent):
                option = (total + cost[units], [*chosen, units - 1])
                if spent + units not in step or option[0] < step[spent + units][0]:
                    step[spent + units] = option
        best = step
    return best[distance + 1]


def plan_groups(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """Bit groups and thresholds. Pairs that agree on a group are counted over all fingerprints; for
    thresholds above 0 the count grows as it would for independent bits."""
    n, both = bit_statistics(prints)
    p = both.diagonal() / max(1, n)
    options = [correlated_groups(n, both, m) for m in range(2, distance + 2)]
    flat = [(m, g, bits) for m, groups in enumerate(options) for g, bits in enumerate(groups)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("key")) for i, (_, _, b) in enumerate(flat)]))
    same = prints.select(rows.alias("r")).groupBy("r.i", "r.key").count().groupBy("i").agg(F.sum((F.col("count").cast("double") * (F.col("count") - 1)) / 2).alias("pairs"))
    pairs = {r["i"]: r["pairs"] for r in same.collect()}
    best = None
    for m, groups in enumerate(options):
        costs = []
        for g, bits in enumerate(groups):
            law = np.array([1.0])
            for b in bits:
                agree = p[b] ** 2 + (1 - p[b]) ** 2
                law = np.convolve(law, [agree, 1 - agree])
            growth = np.cumsum(law) / max(law[0], 1e-300)
            equal = pairs.get(flat.index((m, g, bits)), 0.0)
            probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
            costs.append([0.0, *(ROW_COST * n * float(probes[t]) + min(n * (n - 1) / 2, equal * growth[min(t, len(growth) - 1)]) for t in range(distance + 1))])
        total, thresholds = share_thresholds(costs, distance)
        if best is None or total < best[0]:
            best = (total, [(b, t) for b, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def _mask(bits: Sequence[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the fingerprints; all pairs are looked at, none stored."""
    out, left = [], np.arange(len(prints))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]) <= distance
            if near.any():
                found = left[near]
                out += [(int(i), int(j)) for j in found]
                queue += list(found)
                left = left[~near]
    return out


def links_of_runs(run: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """Links within runs of equal ``run`` numbers: enough of them to connect what is linked."""
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.array([], int)
    lengths = np.diff(np.append(starts, len(run)))
    short = np.repeat(lengths <= SHORT, lengths)
    out = []
    for s in range(1, min(SHORT, len(run))):
        at = np.flatnonzero(short[:-s] & (run[s:] == run[:-s]))
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + s]) <= distance]
        out.append(np.stack([prints[at], prints[at + s]], axis=1))
    for start, length in zip(starts[lengths > SHORT], lengths[lengths > SHORT]):
        own = prints[start : start + length]
        edges = np.array(forest(own, distance), int).reshape(-1, 2)
        out.append(own[edges])
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def hamming_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect exactly those within reach.

    A key with more than BLOCK members is cut into blocks and each pair of blocks is a task of its own,
    so no key is ever whole in one task; the links given are at most a forest for each.
    """
    groups = plan_groups(prints, distance)

    def own_keys(part: int, bits: list[int], threshold: int) -> Column:
        base = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        near = F.array(*[F.lit(m) for m in masks(bits, threshold)])
        return F.transform(near, lambda m: F.struct(F.lit(part).alias("part"), base.bitwiseXOR(m).alias("key")))

    keys = F.explode(F.concat(*[own_keys(i, bits, t) for i, (bits, t) in enumerate(groups)]))
    rows = prints.select("fp", keys.alias("k")).select("fp", "k.*")
    hot = stage(rows.groupBy("part", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1"), "hot_keys")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, block) * F.col("blocks") + F.greatest(o, block))
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.join(hot, ["part", "key"], "left")
        .select("part", "key", "fp", F.explode(cells).alias("cell"))
        .repartition(parts, "part", "key", "cell")
        .sortWithinPartitions("part", "key", "cell")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (ids[1:, :3] != ids[:-1, :3]).any(axis=1))
            found = links_of_runs(np.cumsum(new), ids[:, 3].copy().view(np.uint64), distance).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

        kept = np.empty((0, 4), np.int64)
        for batch in batches:
            ids = np.concatenate([kept, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "key", "cell", "fp")], axis=1)])
            last = np.flatnonzero((ids[:, :3] != ids[-1, :3]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            if cut:
                yield links(ids[:cut])
            kept = ids[cut:]
        if len(kept):
            yield links(kept)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """Every document with ``fp``, ``group`` and ``component_id``, the smallest ``doc_id`` its fingerprint reaches.

    Documents with equal fingerprints are one node. A null text has no words like an empty one; a null
    ``doc_id`` takes part but is never a component's smallest unless there is no other (then null). Rows that repeat
    come out as often. An empty table gives no rows.
    """
    prints = stage(fingerprints(docs, width), "fingerprints")
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = connect(hamming_links(classes, distance)).withColumnRenamed("node", "fp")
    grouped = classes.join(labels, "fp", "left").withColumn("group", F.coalesce("label", "fp"))
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    components = stage(grouped.select("fp", "group").join(smallest, "group"), "components")
    return prints.join(components, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest ``doc_id``, of rows that repeat it the one of
    least text hash; the other rows go. Groups without any id keep one too."""
    found = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("text_hash").alias("hash"))
    kept = found.groupBy("group").agg(F.min(order).alias("k")).select(row_key(F.col("k.doc_id"), F.col("k.hash")).alias("key"))
    rows = packed(docs, "doc_id", "text").withColumn("key", row_key(F.col("doc_id"), F.xxhash64("text")))
    # Texts are shuffled once: the join is on the key that rows that repeat have been combined by.
    return unpacked(rows.dropDuplicates(["key"]).join(kept, "key", "left_semi"), docs.columns, "doc_id", "text")


def row_key(doc_id: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), text_hash.cast("string"))


def fingerprint_hex(fp: str = "fp") -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
