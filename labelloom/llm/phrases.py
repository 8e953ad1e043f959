"""Phrases that stand together more often than their parts would, counted on a prefix-free parse.

A text is cut where the hash of ``longest - 1`` neighbouring words says so; a chunk ends with these words and the next begins with them.
Cuts depend on nothing but those words, so repeated passages give equal chunks, and the distinct chunks with their frequencies are a
dictionary of the corpus. Phrases are counted inside the distinct chunks, weighted by frequency. A phrase that begins in a chunk's last
``longest - 1`` words belongs to the next chunk, unless the text ends there: so each occurrence counts once.

A phrase is frequent only if its words, and its pairs of words, are. Frequent ones are marked in a table of ``1 << BITS`` bits that
tasks hold; a phrase marked by accident is counted for nothing and falls out, so its size changes work and never results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.operators.ranking import BROADCAST_ROWS, skew_safe_lookup
from labelloom.staging import stage

#: Contract of the query: least frequency, words of the longest phrase, phrases of a language, per cent of a longer phrase's share.
LEAST, LONGEST, FIRST, SHARE = 100, 5, 2000, 100
#: One window in ``1 << CHUNK`` cuts; bits of the tables of marks.
CHUNK, BITS = 5, 25
#: Words that a task handles at once, and words that it keeps numbered.
AT_ONCE, HELD = 2_000_000, 400_000
#: What ends a piece becomes a word of its own, which no other word can be.
STOP = b"."
STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", STOP * 9)
BASE, SCRAMBLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, and a stop where a piece ends."""
    return (text or b"").lower().translate(STOPS).replace(STOP, b" . ").split()


def mixed(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of scrambled hashes."""
    return ((hashes ^ hashes >> np.uint64(31)) * SCRAMBLE) >> np.uint64(64 - bits)


def of_runs(hashes: np.ndarray, run: int) -> np.ndarray:
    """A hash of every ``run`` neighbours."""
    size = max(0, len(hashes) - run + 1)
    out = np.zeros(size, np.uint64)
    for i in range(run):
        out = out * BASE + hashes[i : i + size]
    return out


def cuts(hashes: np.ndarray, overlap: int) -> np.ndarray:
    """Where chunks after the first begin, given the words' hashes."""
    found = np.flatnonzero(mixed(of_runs(hashes, overlap), CHUNK) == 0)
    return found[found > 0]


def parse(texts: DataFrame, overlap: int) -> DataFrame:
    """The dictionary of the texts: ``lang, chunk, last, n``; ``last`` if the text ends with the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        counts: Counter = Counter()
        held = 0

        def given() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*counts), [pa.string(), pa.binary(), pa.bool_()])]
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], ["lang", "chunk", "last", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(value.as_py())
                if not tokens:
                    continue
                for word in set(tokens).difference(known):
                    known[word] = zlib.crc32(word)
                at = cuts(np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens)), overlap).tolist()
                for a, b in zip([0, *at], at):
                    counts[lang, b" ".join(tokens[a : b + overlap]), False] += 1
                counts[lang, b" ".join(tokens[at[-1] if at else 0 :]), True] += 1
                held += len(tokens)
                if held > AT_ONCE or len(known) > HELD:
                    yield given()
                    known, held = {}, 0
        if counts:
            yield given()

    parsed = texts.mapInArrow(run, "lang string, chunk binary, last boolean, n long")
    return stage(parsed.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n")), "dictionary")


@dataclass
class Block:
    """Words of many chunks in a row, a stop after each: numbers (0: stop), the chunk's frequency, and whether a phrase that
    begins there belongs to the chunk. ``names`` and ``langs`` by number; ``hashes`` of language and word by number."""

    ids: np.ndarray
    weight: np.ndarray
    own: np.ndarray
    names: list[bytes]
    langs: list[str]
    hashes: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Block]:
    """The chunks of a partition of the dictionary, about ``AT_ONCE`` words at a time."""
    numbers: dict[str, dict[bytes, int]] = {}
    names, langs, hashes = [STOP], [""], [0]
    parts: list[tuple] = []
    held = 0

    def block() -> Block:
        ids, lengths, n, last = map(np.concatenate, zip(*parts))
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))  # words to the chunk's end, its stop included
        own = (left > overlap + 1) | np.repeat(last, lengths)
        return Block(ids, np.repeat(n, lengths), own, names, langs, np.array(hashes, np.uint64))

    for batch in batches:
        given = batch.column("lang").to_pylist()
        for lang in set(given):
            some = batch.take(pa.array([i for i, g in enumerate(given) if g == lang], pa.int64()))
            chunks = some.column("chunk").to_pylist()
            tokens = b" . ".join(chunks).split(b" ") + [STOP]
            own = numbers.setdefault(lang, {STOP: 0})
            for word in set(tokens).difference(own):
                own[word] = len(names)
                names.append(word)
                langs.append(lang)
                hashes.append(zlib.crc32(word, zlib.crc32(lang.encode() + b" ")))
            lengths = np.fromiter((chunk.count(b" ") + 2 for chunk in chunks), np.int64, len(chunks))
            ids = np.fromiter(map(own.__getitem__, tokens), np.int64, len(tokens))
            parts.append((ids, lengths, some.column("n").to_numpy(), some.column("last").to_numpy(zero_copy_only=False)))
            held += len(tokens)
        if held > AT_ONCE or len(names) > HELD:
            yield block()
            numbers, names, langs, hashes, parts, held = {}, [STOP], [""], [0], [], 0
    if parts:
        yield block()


def counted(dictionary: DataFrame, overlap: int, phrases: Callable[[Block], Iterator[tuple]]) -> DataFrame:
    """``lang, phrase, words, n``: sums of what ``phrases`` finds in the blocks: (words per phrase, their numbers, frequencies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, overlap):
            for size, rows, n in phrases(block):
                for start in range(0, len(n), HELD):
                    some = rows[:, start : start + HELD].tolist()
                    texts = list(map(b" ".join, zip(*[map(block.names.__getitem__, ids) for ids in some])))
                    langs = pa.array(list(map(block.langs.__getitem__, some[0])), pa.string())
                    columns = [langs, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.full(len(texts), size), pa.int32()), pa.array(n[start : start + HELD], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])

    found = dictionary.mapInArrow(run, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the sums of their weights, and every key's number."""
    number, distinct = pd.factorize(keys)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, number, weight)
    return distinct, sums, number


def single_words(block: Block) -> Iterator[tuple]:
    at = np.flatnonzero(block.own & (block.ids > 0))
    distinct, sums, _ = summed(block.ids[at], block.weight[at])
    yield 1, distinct[None], sums


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = mixed(hashes, BITS)
    return (marks[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def pairs(block: Block, good_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, and whether both are marked in the one chunk and piece."""
    good = (block.ids > 0) & marked(good_words, block.hashes)[block.ids]
    return of_runs(block.hashes[block.ids], 2), good[:-1] & good[1:]


def frequent_pairs(dictionary: DataFrame, overlap: int, least: int, good_words: np.ndarray) -> np.ndarray:
    """Marks of the pairs of marked words that occur ``least`` times.

    Most pairs are rare, and their words would fill a shuffle. So pairs are counted by hashes alone, of which the first bits are a range
    and 32 more are kept in arrays; ranges follow the number of shuffle partitions. Pairs whose hashes agree share a count, so some
    rare ones are marked; phrases are counted by their words later.
    """
    ranges = (4 * int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, overlap):
            hashes, good = pairs(block, good_words)
            at = np.flatnonzero(good & block.own[:-1])
            distinct, sums, _ = summed(mixed(hashes[at], ranges + 32), block.weight[at])
            order = np.argsort(distinct)
            distinct, sums = distinct[order], np.minimum(sums[order], least).astype(np.uint32)
            places, low = (distinct >> np.uint64(32)).astype(np.int32), distinct.astype(np.uint32)
            begins = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else []
            ends = [*begins[1:], len(places)]
            columns = [[x[a:b].tobytes() for a, b in zip(begins, ends)] for x in (low, sums)]
            yield pa.RecordBatch.from_arrays([pa.array(places[begins] if len(places) else [], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["place", "low", "n"])

    def add(group: pa.Table) -> pa.Table:
        low, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint32) for c in ("low", "n"))
        distinct, sums, _ = summed(low, n)
        often = np.sort(distinct[sums >= least]).astype(np.uint64) | np.uint64(group.column("place")[0].as_py()) << np.uint64(32)
        return pa.table(cells_of(often >> np.uint64(ranges + 32 - BITS)))

    counts = dictionary.mapInArrow(run, "place int, low binary, n binary")
    return table_of_marks(counts.groupBy("place").applyInArrow(add, "cell int, bits long"))


def longer_phrases(good_words: np.ndarray, good_pairs: np.ndarray, longest: int) -> Callable[[Block], Iterator[tuple]]:
    """Phrases of two words and more, all of whose words and pairs are marked."""

    def phrases(block: Block) -> Iterator[tuple]:
        hashes, good = pairs(block, good_words)
        good[good] = marked(good_pairs, hashes[good])
        at = np.flatnonzero(good & block.own[:-1])
        steps = block.ids[at]
        rows: list[np.ndarray] = []
        for size in range(2, longest + 1):
            if size > 2:  # phrases whose next pair is good too
                further = good[np.minimum(at + size - 2, len(good) - 1)] & (at + size - 1 < len(block.ids))
                at, steps = at[further], steps[further]
            if not len(at):
                return
            distinct, sums, steps = summed(steps * len(block.names) + block.ids[at + size - 1], block.weight[at])
            before, word = distinct // len(block.names), distinct % len(block.names)
            rows = [*(r[before] for r in rows), word] if size > 2 else [before, word]
            yield size, np.stack(rows), sums

    return phrases


def cells_of(places: np.ndarray) -> dict[str, pa.Array]:
    """The marks at places, as words of 64 bits."""
    bits = np.uint64(1) << (places & np.uint64(63))
    return {"cell": pa.array((places >> np.uint64(6)).astype(np.int32)), "bits": pa.array(bits.view(np.int64))}


def table_of_marks(cells: DataFrame) -> np.ndarray:
    """All marks in one table: at most ``1 << BITS`` bits reach the driver."""
    found = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << BITS - 6), np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_words(words: DataFrame) -> np.ndarray:
    """Marks of the rows ``lang, phrase`` of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            hashes = [zlib.crc32(word.encode(), zlib.crc32(lang.encode() + b" ")) for lang, word in keys]
            yield pa.RecordBatch.from_pydict(cells_of(mixed(np.array(hashes, np.uint64), BITS)))

    return table_of_marks(words.select("lang", "phrase").mapInArrow(run, "cell int, bits long"))


def frequencies(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all phrases that occur at least ``least`` times, and ``lang, n`` of all words."""
    overlap = longest - 1
    dictionary = parse(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary")), overlap)
    all_words = stage(counted(dictionary, overlap, single_words), "words")
    frequent = all_words.where(F.col("n") >= least)
    good_words = frequent_words(frequent)
    good_pairs = frequent_pairs(dictionary, overlap, least, good_words)
    longer = counted(dictionary, overlap, longer_phrases(good_words, good_pairs, longest)).where(F.col("n") >= least)
    together = frequent.unionByName(stage(longer, "phrases"))
    return together, stage(all_words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, share: int = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``first`` phrases.

    A phrase of 2 to ``longest`` words that occurs ``a >= least`` times in a language of ``n`` words is cut into two parts that occur
    ``l`` and ``r`` times; its score is floor(1000 a n / (l r)) at the cut where that is lowest, the earliest of such. Phrases are left out
    that lie in a longer one with at least ``share`` per cent of their occurrences. Order: score and occurrences descending, phrase.

    A null text is empty, a null lang is ``und``; repeated rows count each; texts without words add nothing, so a language, or a table, that
    has none gives no rows; other columns are ignored. Products are decimals of 38 digits: enough for 10 ** 17 words.
    """
    if longest < 3:
        raise ValueError("Phrases of at least three words are needed for the parse.")
    table, totals = frequencies(docs, least, longest)
    table = table.select("lang", "phrase", "words", F.col("n").alias("a"))
    candidates = table.where("words > 1").withColumn("split", F.split("phrase", " "))

    def part(begin, length):
        return F.array_join(F.slice("split", begin, length), " ")

    # Whatever lies in a longer phrase also lies in one that is a word longer, and that one occurs at least as often.
    inside = candidates.where("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    free = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within") < share * F.col("a"), F.lit(True)))
    cut = stage(
        free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
            "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
        ),
        "cuts",
    )
    for side, out in (("left", "l"), ("right", "r")):
        uses = cut.groupBy("lang", F.col(side).alias("phrase")).agg(F.count(F.lit(1)).alias("uses"))
        found = uses.join(table.select("lang", "phrase", F.col("a").alias(out)), ["lang", "phrase"]).withColumnRenamed("phrase", side)
        cut = skew_safe_lookup(cut, found, ["lang", side], [out], "uses", "phrase")
    cut = cut.join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")} | {"n": F.col("total").cast("decimal(18,0)")}
    over = (wide["a"] * F.lit(1000).cast("decimal(4,0)") * wide["n"]).cast("decimal(38,0)")
    scored = cut.withColumn("over", over).withColumn("under", wide["l"] * wide["r"]).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "total")).alias("cut"))
    kept = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", F.col("cut.total").alias("n"), "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
