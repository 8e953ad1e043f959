"""Brown class-based bigrams: P(w | v) = P(class of w | class of v) * P(w | class of w).

Every word of the dictionary has a class of its own. Exchange clustering on the driver seeds the classes: its units are the most
frequent words, all others by their last bytes, a table of fixed size. Then Spark sweeps over all texts: each word's neighbours
are counted by their classes, and each word, where its counts lie, moves to the class that gains most while the others stay. A
sweep moves all words at once, so the likeliest classes met are kept. Words outside the dictionary share units by their last bytes,
and move as such. So the units follow the vocabulary as far as the dictionary goes.

The counts behind transitions and emissions are of all words of all texts. Counts of the dictionary's words are held by every
task; those of other words come from a join with the table of all counts. Repeated rows count each time, a null id is a row as
any other and is trained on, further columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.staging import stage

#: Single words that seed the classes, units of endings, bytes of an ending, classes.
SINGLE, ENDINGS, ENDING, CLASSES = 1024, 256, 3, 64
#: Words whose counts every task holds.
DICTIONARY = 1 << 17
#: Sweeps over the seeds at most, and over all texts.
SWEEPS, REFINEMENTS = 12, 2
#: Ranges of units whose neighbours are counted apart.
RANGES = 1024
#: Partial counts that a task holds, and tokens or rows that it handles at once.
HELD, AT_ONCE = 300_000, 500_000
#: A text's end; no word is empty.
END = b""
ADDED = 0.5


def words(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, cut at ASCII white space."""
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts, the end of each text counted as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(words(text.as_py()))
                if len(counts) > HELD:
                    yield given()
            counts[END] += batch.num_rows
        if counts:
            yield given()

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words above a count that at most ``most`` words exceed, most frequent first, with their counts.

    The count is read off a histogram on a logarithmic scale.
    """
    scale = F.floor(F.log2("n") * 16)
    steps = counts.where(F.col("word") != F.lit(END)).groupBy(scale.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return [], np.empty(0, np.int64)
    table = counts.where((F.col("word") != F.lit(END)) & (F.col("n") >= least)).toArrow().to_pydict()
    pairs = sorted(zip(table["n"], table["word"]), key=lambda p: (-p[0], p[1]))
    return [w for _, w in pairs], np.array([n for n, _ in pairs], np.int64)


@dataclass
class Lexicon:
    """The dictionary with its counts. Unit 0 is the end, then one for each word, then the endings of all other words."""

    words: list[bytes]
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.first_ending = 1 + len(self.words)
        self.units = self.first_ending + ENDINGS

    def ending(self, word: bytes) -> int:
        return self.first_ending + zlib.crc32(word[-ENDING:]) % ENDINGS

    def seeds(self) -> np.ndarray:
        """The seeding unit of each unit: itself, for the end and the most frequent words; by its ending else."""
        single = min(SINGLE, len(self.words))
        endings = [self.ending(w) for w in self.words[single:]]
        rest = np.array([*endings, *range(self.first_ending, self.units)], np.int64) - self.first_ending + 1 + single
        return np.concatenate([np.arange(1 + single), rest])

    def index(self) -> dict[bytes, int]:
        return dict(zip(self.words, range(len(self.words))))

    def units_of(self, tokens: list[bytes], index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words (-1: not in the dictionary) and their units."""
        known = np.fromiter(map(index.get, tokens, repeat(-1)), np.int64, len(tokens))
        units = known + 1
        rest = np.flatnonzero(known < 0)
        units[rest] = [self.ending(tokens[i]) for i in rest]
        return known, units


def unit_texts(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The units of each text as little-endian 32-bit numbers, its end last, written once for all sweeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, waiting, held = lexicon.index(), [], 0
        for batch in batches:
            for text in batch.column(0):
                units = np.append(lexicon.units_of(words(text.as_py()), index)[1], 0).astype("<i4")
                waiting.append(units.tobytes())
                held += len(units)
                if held > AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], ["units"])
                    waiting, held = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(waiting, pa.binary())], ["units"])

    return stage(texts.select(F.col("text").cast("binary")).mapInArrow(run, "units binary"), "units")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Whole texts' units, one after the other, about ``AT_ONCE`` of them at a time."""
    waiting, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            waiting.append(np.frombuffer(text.as_buffer(), "<i4"))
            held += len(waiting[-1])
            if held > AT_ONCE:
                yield np.concatenate(waiting)
                waiting, held = [], 0
    if waiting:
        yield np.concatenate(waiting)


def class_pairs(units: DataFrame, own: np.ndarray, classes: int) -> np.ndarray:
    """How often one class follows another, over all texts; a text starts after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for run_units in runs(batches):
            found = own[run_units]
            total += np.bincount(np.append(0, found[:-1]) * classes + found, minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    cells = units.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out.reshape(classes, classes)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units: each unit in turn moves where the likelihood of the class bigrams gains most.

    Class 0 is unit 0 alone. Units start in turn over the others; ties leave a unit where it is. Ends when a sweep moves
    nothing.
    """
    n = len(pairs)
    classes = max(2, min(classes, n))
    own = np.array([0, *(1 + i % (classes - 1) for i in range(n - 1))])
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    right, left = pairs @ member, pairs.T @ member  # counts of a unit before, after each class
    table = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-pairs.sum(axis=1)[1:], kind="stable") + 1:
            a, self_pairs = own[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= self_pairs
            l[a] -= self_pairs
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= self_pairs
            rows, cols, corner = table.sum(axis=1), table.sum(axis=0), table.diagonal()
            n_r, n_l = r.sum() + self_pairs, l.sum() + self_pairs
            gain = (xlogx(table + r) - xlogx(table)).sum(axis=1) + (xlogx(table + l[:, None]) - xlogx(table)).sum(axis=0)
            gain += xlogx(corner + r + l + self_pairs) - xlogx(corner + r) - xlogx(corner + l) + xlogx(corner)
            gain -= xlogx(rows + n_r) - xlogx(rows) + xlogx(cols + n_l) - xlogx(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += self_pairs
            if b != a:
                moved += 1
                own[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
        if not moved:
            break
    return own


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to what no choice of classes changes."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def best_classes(unit: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For units with the counts of classes after and before them: the class that gains most, all other units staying.

    A unit beside itself counts as a neighbour that stays. Class 0 is no choice. Ties leave a unit where it is; among other
    classes, such as empty ones, units take turns by their numbers, so that they do not all move to the same one.
    """
    n, classes = after.shape
    gain = np.zeros((n, classes))
    for counts, cells in ((after, table), (before, table.T)):
        row, d = np.nonzero(counts)
        c = counts[row, d].astype(float)
        rest = cells[:, d].T  # per count, what each class has without the unit
        rest[np.arange(len(row)), own[row]] -= c
        rest = np.maximum(rest, 0.0)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        if len(row):
            gain[row[starts]] += np.add.reduceat(xlogx(rest + c[:, None]) - xlogx(rest), starts)
        whole = counts.sum(axis=1, dtype=float)
        totals = np.repeat(cells.sum(axis=1)[None, :], n, axis=0)
        totals[np.arange(n), own] -= whole
        totals = np.maximum(totals, 0.0)
        gain -= xlogx(totals + whole[:, None]) - xlogx(totals)
    gain[:, 0] = -np.inf
    stay = gain[np.arange(n), own]
    tied = gain >= gain.max(axis=1, keepdims=True) - 1e-9
    chosen = unit % tied.sum(axis=1)
    best = (np.cumsum(tied, axis=1) > chosen[:, None]).argmax(axis=1)
    return np.where((own > 0) & (gain[np.arange(n), best] > stay + 1e-9), best, own)


def moved(units: DataFrame, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes of all units after a sweep over all texts.

    A task counts neighbours as ``unit, side, class`` and sends what it found in ranges of units; a range's counts meet in one
    place, are added up in a table of fixed size, and its units are weighed there. The driver receives the units that move.
    """
    size, classes = len(own), len(table)
    wide = 2 * classes
    per_range = -(-size // RANGES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((per_range * RANGES, wide), np.int32).ravel()
        for run_units in runs(batches):
            place = (run_units % RANGES).astype(np.int64) * per_range + run_units // RANGES
            place *= wide
            found = own[run_units]
            # The end that the first text starts after is the last cell; that of the last text has nothing after it here.
            cells = np.concatenate([place[:-1] + found[1:], place + classes + np.append(0, found[:-1]), [found[0]]])
            at, n = np.unique(cells, return_counts=True)
            total[at] += n.astype(np.int32)
        cut = per_range * wide
        for r in range(RANGES):
            part = total[r * cut : (r + 1) * cut]
            at = np.flatnonzero(part)
            if len(at):
                lists = [pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([part[at]], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *lists], ["range", "cells", "n"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, cells, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                total = ranges.setdefault(r, np.zeros(per_range * wide, np.int64))
                total[cells.values.to_numpy()] += n.values.to_numpy()
        for r, total in ranges.items():
            some = np.arange(r, size, RANGES)
            counts = total.reshape(per_range, wide)[: len(some)]
            found = best_classes(some, counts[:, :classes], counts[:, classes:], own[some], table)
            at = np.flatnonzero(found != own[some])
            yield pa.RecordBatch.from_arrays([pa.array(some[at].astype(np.int32)), pa.array(found[at].astype(np.int32))], ["unit", "class"])

    schema = "range int, cells array<int>, n array<int>"
    found = units.mapInArrow(count, schema).repartition("range").mapInArrow(weigh, "unit int, class int").toArrow()
    out = own.copy()
    out[found.column("unit").to_numpy()] = found.column("class").to_numpy()
    return out


def clustered(units: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and the class bigrams: seeds, then sweeps over all texts, the likeliest of these kept."""
    seeds = lexicon.seeds()
    own = exchange(class_pairs(units, seeds, int(seeds.max()) + 1), CLASSES)[seeds]
    classes = int(own.max()) + 1
    table = class_pairs(units, own, classes)
    best = (likelihood(table), own, table)
    for _ in range(REFINEMENTS):
        following = moved(units, own, table)
        if (following == own).all():
            break
        own, table = following, class_pairs(units, following, classes)
        best = max(best, (likelihood(table), own, table), key=lambda found: found[0])
    return best[1], best[2]


@dataclass
class Model:
    """``step[c, d]``: log10 of P(d | c) over the total of class d; ``base``: log10 of the unigram denominator."""

    lexicon: Lexicon
    unit_class: np.ndarray
    step: np.ndarray
    end: int
    tokens: int
    base: float


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts, and the table of all counts, written once.

    A class gives a word (count + 0.5) over its words' sum, and 0.5 to any word never seen whose ending belongs to
    it. Class transitions fall back on the class's own share with the weight of half as many observations as there are
    classes. Both sum to one.
    """
    counts = stage(word_counts(texts), "counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
    tokens, types, ends = whole["n"] or 0, whole["v"], whole["ends"] or 0
    lexicon = Lexicon(*frequent(counts, DICTIONARY))
    unit_class, table = clustered(unit_texts(texts, lexicon), lexicon)
    classes = len(table)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n, v = lexicon.index(), np.zeros(ENDINGS), np.zeros(ENDINGS)
        for batch in batches:
            known, units = lexicon.units_of(batch.column(0).to_pylist(), index)
            units, found = units[known < 0] - lexicon.first_ending, batch.column(1).to_numpy()[known < 0]
            n += np.bincount(units, found, ENDINGS)
            v += np.bincount(units, minlength=ENDINGS)
        columns = [pa.array(range(ENDINGS), pa.int32()), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["ending", "n", "v"])

    endings = counts.where(F.col("word") != F.lit(END)).mapInArrow(others, "ending int, n long, v long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    total = np.bincount(unit_class[1 : lexicon.first_ending], lexicon.counts + ADDED, classes).astype(float)
    for r in endings:
        total[unit_class[lexicon.first_ending + r["ending"]]] += r["n"] + ADDED * r["v"]
    total[0] = ends + ADDED
    total[np.unique(unit_class[lexicon.first_ending :])] += ADDED
    share = (table.sum(axis=0) + ADDED) / (table.sum() + ADDED * classes)
    weight = classes / 2
    follow = (table + weight * share) / (table.sum(axis=1, keepdims=True) + weight)
    step = np.log10(follow) - np.log10(np.maximum(total, ADDED))
    return Model(lexicon, unit_class, step, ends, tokens, float(np.log10(tokens + ADDED * (types + 1)))), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row; a null text is only an end.

    Texts are read once and whole: what frequent words contribute is summed on the spot; each document's other words,
    with their numbers, meet their counts in a join on the word.
    """
    lexicon = model.lexicon
    logs = np.log10(lexicon.counts + ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, row = lexicon.index(), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = words(text.as_py())
                known, units = lexicon.units_of(tokens, index)
                classes = np.append(model.unit_class[units], 0)
                steps = float(model.step[np.append(0, classes[:-1]), classes].sum())
                seen = known[known >= 0]
                common = float(logs[seen].sum() + np.log10(model.end + ADDED))
                out.append((row, doc_id, len(tokens) + 1, len(seen) + (model.end > 0), common, steps, None, None))
                rest = Counter(tokens[i] for i in np.flatnonzero(known < 0))
                out += [(row, None, None, None, None, None, w, n) for w, n in rest.items()]
                row += 1
                if len(out) > HELD // 2:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    names = ["row", "doc_id", "n_tokens", "n_known", "common", "steps", "word", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "row long, doc_id long, n_tokens long, n_known long, common double, steps double, word binary, n long"
    read = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema), "read")
    found = F.coalesce(F.col("c"), F.lit(0))
    rest = (
        read.where("word IS NOT NULL")
        .select("row", "word", "n")
        .join(counts.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(found + ADDED)).alias("rest"), F.sum(F.when(found > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    )
    summed = F.col("common") + F.coalesce("rest", F.lit(0.0))
    return (
        read.where("word IS NULL")
        .select("row", "doc_id", "n_tokens", "n_known", "common", "steps")
        .join(rest, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (summed - F.col("n_tokens") * F.lit(model.base)).alias("base_score"),
            (summed + F.col("steps")).alias("score"),
        )
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def fit_and_score(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; perplexity is 10 ** (-score / n_tokens)."""
    model, counts = fit(docs.where(~held_out()))
    return score(docs, model, counts)
