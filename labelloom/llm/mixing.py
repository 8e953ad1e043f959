"""Mixing sources to target weights by fixed-length blocks.

The words of a source, document after document in a seeded order, are cut into blocks. Every output
shard draws how many of its slots each source gets; the slots of a source, numbered over all
shards, go through a pseudorandom permutation of its block numbers, and the blocks are joined by number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import WORD, in_order, packed, unpacked
from labelloom.staging import stage

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK, SLOTS = 256, 1024
#: So many slots or fewer are drawn one by one.
ONE_BY_ONE = 8


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: ``share`` of all by weight, none above ``most`` times its size.

    What sources at their limit leave is shared by weight among the others, until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = rest / sum(weight[i] for i in free)
        over = [i for i in free if weight[i] * unit > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weight[i] * unit
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
            free.remove(i)
    return out


def feistel(values: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0 .. n-1, or its inverse, applied to ``values``; nothing of size n is stored."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}|{r}".encode()).digest()[:8], "big") | 1) for r in range(4)]

    def mixed(part: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (part + k) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * k >> np.uint64(32)) & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in reversed(keys) if inverse else keys:
            left, right = (right ^ mixed(left, k), left) if inverse else (right, left ^ mixed(right, k))
        return left << shift | right

    with np.errstate(over="ignore"):
        out = once(values.astype(np.uint64))
        while (outside := out >= n).any():  # walk the cycle until it is inside again
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def words_before(slot: int, size: int, block: int, key: str) -> int:
    """Words in the first ``slot`` slots of a source: all its blocks are whole but the last."""
    blocks = -(-size // block)
    rounds, inside = divmod(slot, blocks)
    place = int(feistel(np.array([blocks - 1]), blocks, f"{key}|{rounds}", inverse=True)[0])
    return rounds * size + inside * block - (blocks * block - size if place < inside else 0)


def slots_needed(target: float, size: int, block: int, key: str) -> tuple[int, int]:
    """The fewest slots that hold ``target`` words, and the words wanted of the last of them."""
    wanted = round(target)
    if not wanted or not size:
        return 0, 0
    low, high = 1, int(MOST * -(-size // block)) + 1
    while low < high:
        middle = (low + high) // 2
        if words_before(middle, size, block, key) >= wanted:
            high = middle
        else:
            low = middle + 1
    return low, wanted - words_before(low - 1, size, block, key)


def good_draws(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` items drawn without return are good: the hypergeometric law, for numbers of any size.

    Items lie in a random order, the first ``take`` are drawn. The place of the j-th good one, as a share of the order, has a beta law, and
    the bad ones before it a binomial law. With j about the number expected, what then is left to decide is about the root of ``take``.
    """
    got, sign = 0, 1
    while take > ONE_BY_ONE:
        if 2 * take > good + bad:  # those that are not drawn are fewer
            got, sign, take = got + sign * good, -sign, good + bad - take
            continue
        j = good * take // (good + bad)
        if j == 0:  # count the bad ones
            got, sign, good, bad = got + sign * take, -sign, bad, good
            continue
        before = int(rng.binomial(bad, rng.beta(j, good - j + 1)))
        if j + before <= take:
            got, good, bad, take = got + sign * j, good - j, bad - before, take - j - before
        else:
            good, bad = j - 1, before
    for _ in range(take):
        if rng.integers(good + bad) < good:
            got, good = got + sign, good - 1
        else:
            bad -= 1
    return got


def split_draw(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric: of ``take`` slots out of a pool, how many are each source's."""
    out, pool, rest = np.zeros(len(left), np.int64), int(left.sum()), take
    for i, n in enumerate(map(int, left)):
        if rest and n:
            out[i] = good_draws(n, pool - n, rest, rng)
        pool, rest = pool - n, rest - int(out[i])
    return out


def shard_counts(shard: int, shards: int, per_source: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and in all earlier shards.

    A multinomial draw given the sources' totals. Halving the shards, with a generator for each half,
    gives any one shard's draw in a few steps and every task the same draws.
    """
    low, high, pool, before = 0, shards, per_source.copy(), np.zeros_like(per_source)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_draw(pool, min(int(pool.sum()), (middle - low) * slots), rng)
        if shard < middle:
            high, pool = middle, left
        else:
            low, pool, before = middle, pool - left, before + left
    return pool, before


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """``docs``: one row per document row with ``row`` (its place), ``start`` (words of its source before it)
    and its source's figures; ``slots``: (shard, slot, source_index, block, words, round);
    each round of a source's slots visits a block at most once."""

    def __init__(self, docs: DataFrame, slots: DataFrame, block: int):
        self.docs, self.slots, self.block = docs, slots, block

    def pieces(self) -> DataFrame:
        """What the mix takes: a row for each document and slot that overlap, with the word range
        ``low`` to ``high`` of the document."""
        b, end = F.lit(self.block), F.col("start") + F.col("size")
        blocks = F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")))
        spread = self.docs.where("size > 0").select("row", "source_index", "start", "size", blocks.alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(end, F.col("block") * b + F.col("words"))
        return (
            # The planner cannot know how many rows the draw makes; they grow with the words, so no broadcast.
            spread.join(self.slots.hint("merge"), ["source_index", "block"])
            .where(low < high)
            .select("row", "shard", "slot", "round", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high"))
        )


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 42, keep: Sequence[str] = ()) -> Mix:
    """Draw a mix of all documents; sources by code point, null last, have WEIGHTS in turn.

    A null text has no words; a document without words is never taken. Repeated rows are documents of their
    own. The driver holds one row per source. The last slot of a source is cut so that the
    words taken meet its target to the word. Targets never exceed twice the source and each
    round of slots uses a block once, so nothing is taken more than twice.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", word_count().alias("size"), *keep, F.xxhash64(F.lit(seed), "doc_id").alias("_seeded"), F.xxhash64("doc_id", "source", "text", *keep).alias("_row"))
    ordered = in_order(rows if keep else stage(rows, "sizes"), ["source", "_seeded", "doc_id", "_row"], "size")
    placed = ordered.with_places("row", "before").drop("_seeded", "_row")
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("_base")).collect()
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in sources]
    wanted = targets(sizes)
    plans = [slots_needed(t, s, block, f"{seed}|{i}") for i, (t, s) in enumerate(zip(wanted, sizes))]
    table = pa.table(
        {
            "source": pa.array([r["source"] for r in sources], pa.string()),
            "source_index": pa.array(range(len(sources)), pa.int32()),
            "source_size": pa.array(sizes, pa.int64()),
            "target": pa.array(wanted, pa.float64()),
            "_base": pa.array([r["_base"] for r in sources], pa.int64()),
        }
    )
    known = spark.createDataFrame(table).withColumnRenamed("source", "_source")
    documents = (
        placed.join(known, placed["source"].eqNullSafe(known["_source"]))
        .withColumn("start", F.col("before") - F.col("_base"))
        .drop("_source", "_base", "before")
    )
    per_source = np.array([n for n, _ in plans], np.int64)
    shards = max(1, -(-int(per_source.sum()) // slots))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = shard_counts(shard, shards, per_source, slots, seed)
                place = feistel(np.arange(max(1, counts.sum())), max(1, int(counts.sum())), f"{seed}|shard|{shard}")
                done = 0
                for i in np.flatnonzero(counts):
                    n, size = int(counts[i]), sizes[i]
                    own, blocks = before[i] + np.arange(n), -(-size // block)
                    number = np.empty(n, np.int64)
                    for r in np.unique(own // blocks):
                        at = own // blocks == r
                        number[at] = feistel(own[at] % blocks, blocks, f"{seed}|{i}|{r}")
                    words = np.minimum(block, size - number * block)
                    words[own == per_source[i] - 1] = np.minimum(words[own == per_source[i] - 1], plans[i][1])
                    frame = {"shard": np.full(n, shard), "slot": place[done : done + n], "source_index": np.full(n, i, np.int32), "block": number, "words": words, "round": own // blocks}
                    done += n
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(frame), preserve_index=False)

    drawn = spark.range(shards).mapInArrow(draw, "shard long, slot long, source_index int, block long, words long, round long")
    return Mix(documents, drawn, block)


def taken_words(mixed: Mix) -> DataFrame:
    """Every document row with ``size``, ``source_size``, ``target`` and the words ``taken`` of it."""
    columns = ["row", "doc_id", "size", "source_size", "target"]
    got = mixed.pieces().groupBy("row").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    return (
        mixed.docs.select(*columns)
        .join(got, "row", "left")
        .select(*columns[1:], F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))
    )


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of the ranges with the white space inside each, the ranges on lines of their own."""
    octets = text.encode()
    spans = [m.span() for m in re.finditer(WORD.encode(), octets)]
    return "\n".join(octets[spans[low][0] : spans[high - 1][1]].decode() for low, high in ranges)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each document and round in which words of it are taken.

    A document taken whole keeps its text; one taken in part has the words taken, in order. ``n_chars``, if there, is that of
    the text. Columns stay those of ``docs``.
    """
    own = ("doc_id", "source", "text", "n_chars") if "n_chars" in docs.columns else ("doc_id", "source", "text")
    mixed = mix(packed(docs, *own), keep=[*own[2:], "rest"])
    pieces = mixed.pieces().groupBy("row", "round").agg(
        F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"), F.sum(F.col("high") - F.col("low")).alias("taken")
    )
    joined = mixed.docs.join(pieces, "row")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([t if w else cut_words(t, merged([(r["low"], r["high"]) for r in rs])) for t, rs, w in zip(texts, ranges, whole)])

    out = joined.withColumn("text", cut("text", "ranges", F.col("taken") == F.col("size")))
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return unpacked(out, docs.columns, *own)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in ranges:
        if out and out[-1][1] == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out
