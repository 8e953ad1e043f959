"""Packing token sequences: dominance reduction by Martello and Toth, then best fit.

Only the number of pieces of each length matters for the packing, so the driver works on a histogram of
at most ``capacity`` entries whatever the number of documents; it finds how many sequences get which
lengths. Which piece goes to which of them follows from its place among the pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from labelloom.llm.common import in_order, kept_by_worker
from labelloom.staging import stage

CAPACITY = 2048
#: tiktoken's regular expression gives up on runs of white space of about a million; longer ones than this never go there.
RUN = 500_000
SPACES = re.compile(r"\s{2,}")
#: A pattern: so many sequences that each hold (length, copies), ...
Pattern = tuple[int, tuple[tuple[int, int], ...]]

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str):
    """A function from text to ids (numpy, unsigned 32 bits) for a vocabulary in two equal files.

    tiktoken gives the same ids as tokenizers in a quarter of the time; texts that name the special token are
    left to tokenizers, which gives it its own id, and so are texts that tiktoken cannot take: those with very long
    runs of white space, and any on which it panics.
    """

    def make():
        exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if "<|" not in text and not (len(text) > RUN and any(m.end() - m.start() > RUN for m in SPACES.finditer(text))):
                try:
                    return np.array(fast.encode_ordinary(text), np.uint32)
                except BaseException as error:  # a panic is no Exception
                    if type(error).__name__ != "PanicException":
                        raise
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

        return encode

    return kept_by_worker(f"encoder {vocabulary}", make)


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and a final 0, cut if longer than ``capacity``.

    Every piece but the first then has ``capacity`` tokens. A null or empty text is the single id 0. A null
    ``doc_id`` stays null; repeated rows are packed as often as they occur; other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids_of, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids_of, batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                starts = [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=PIECES.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Sizes:
    """A multiset of lengths: counts, and the lengths in order."""

    def __init__(self, counts: Mapping[int, int]):
        self.count = Counter({k: v for k, v in counts.items() if v > 0})
        self.sorted = sorted(self.count)

    def take(self, pattern: Counter, times: int) -> None:
        for length, copies in pattern.items():
            self.count[length] -= copies * times
            if not self.count[length]:
                del self.count[length]
                del self.sorted[bisect_left(self.sorted, length)]

    def smallest(self, above: int, without: Counter, n: int) -> list[int]:
        """The ``n`` smallest longer than ``above``, as if ``without`` were taken out."""
        found: list[int] = []
        for length in self.sorted[bisect_right(self.sorted, above) :]:
            found += [length] * min(n - len(found), self.count[length] - without[length])
            if len(found) == n:
                break
        return found

    def largest(self, most: int, without: Counter) -> int:
        """The largest of at most ``most``, as if ``without`` were taken out; 0 if there is none."""
        i = bisect_right(self.sorted, most) - 1
        while i >= 0 and self.count[self.sorted[i]] <= without[self.sorted[i]]:
            i -= 1
        return self.sorted[i] if i >= 0 else 0


def dominating(sizes: Sizes, length: int, capacity: int) -> Counter | None:
    """A set with one item of ``length`` that dominates every feasible set with it, if three items show it.

    One set dominates another when the other's items can be grouped so that each group is no larger than
    an item of its own in the first; some best packing then has the first set as a sequence.
    """
    room, own = capacity - length, Counter([length])
    least = sizes.smallest(0, own, 3)
    if not least or least[0] > room:
        return own
    first = sizes.largest(room, own)
    pair = own + Counter([first])
    if first == room or sum(least[:2]) > room or len(least) < 2:
        return pair
    if len(least) == 3 and sum(least) <= room:
        return None
    # At most two others fit. They are no match for ``first`` alone if no pair is larger,
    best, i = 0, bisect_right(sizes.sorted, room)
    for a in reversed(sizes.sorted[:i]):
        if 2 * a <= best or sizes.count[a] <= own[a]:
            continue
        if b := sizes.largest(min(a, room - a), own + Counter([a])):
            best = max(best, a + b)
    if first >= best:
        return pair
    # nor for ``first`` and the largest beside it if no two that are both larger than the latter fit.
    second = sizes.largest(room - first, pair)
    if second:
        larger = sizes.smallest(second, own, 2)
        if len(larger) < 2 or sum(larger) > room:
            return pair + Counter([second])
    return None


def reduce_instance(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Fix dominating sets until none is found: the fixed patterns, and the counts that remain.

    A dominating set stays one while equal sets are taken out, as alternatives only become fewer, so
    it is fixed as often as the counts allow at once.
    """
    sizes, fixed, changed = Sizes(counts), [], True
    while changed:
        changed = False
        for length in sorted(sizes.count, reverse=True):
            while sizes.count.get(length, 0) and (found := dominating(sizes, length, capacity)):
                times = min(sizes.count[x] // n for x, n in found.items())
                fixed.append((times, tuple(sorted(found.items(), reverse=True))))
                sizes.take(found, times)
                changed = True
    return fixed, dict(sizes.count)


def best_fit(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit over decreasing lengths, all pieces of one length at a time."""
    full: list[Pattern] = []
    open_at: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(times: int, content: tuple, room: int) -> None:
        if not times:
            return
        if room == 0:
            full.append((times, content))
            return
        if room not in open_at:
            open_at[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_at[room].append((times, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                times, content = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[i]
            else:
                room, times, content = capacity, left, ()
            each = room // length  # the fullest sequence takes pieces until none fits
            filled = min(times, left // each)
            put(filled, (*content, (length, each)), room - each * length)
            left -= filled * each
            if filled < times:
                some = left
                put(1 if some else 0, (*content, (length, some)), room - some * length)
                left = 0
                if content:
                    put(times - filled - (1 if some else 0), content, room)
    return full + [p for groups in open_at.values() for p in groups]


def plan_sequences(counts: Mapping[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Intervals over the pieces in order of length: ``start``, ``each`` (pieces a sequence), ``sequence``, ``offset``, ``length``."""
    fixed, rest = reduce_instance(counts, capacity)
    base, place = {}, 0
    for length in sorted(counts):
        base[length] = place
        place += counts[length]
    rows, sequence = [], 0
    for times, content in fixed + best_fit(rest, capacity):
        offset = 0
        for length, copies in content:
            rows.append((base[length], copies, sequence, offset, length))
            base[length] += times * copies
            offset += length * copies
        sequence += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("start", "each", "sequence", "offset", "length"), columns))


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with ``sequence_id`` and ``offset``; an empty table gives no rows.

    Pieces of one length are alike for the packing; they are told apart by their place in the order of
    (length, doc_id, piece, start, ids_crc32), which no hot length or document can overload.
    """
    pieces = stage(token_pieces(docs, vocabulary, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_sequences(counts, capacity)
    placed = in_order(pieces, ["length", "doc_id", "piece", "start", "ids_crc32"]).with_places("place")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            i = np.searchsorted(plan["start"], place, side="right") - 1
            past, each = place - plan["start"][i], plan["each"][i]
            sequence = plan["sequence"][i] + past // each
            offset = plan["offset"][i] + past % each * plan["length"][i]
            columns = [batch.column(c) for c in range(batch.num_columns - 1)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return placed.mapInArrow(assign, PIECES + ", sequence_id long, offset long")
