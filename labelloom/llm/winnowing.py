"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash; of every ``WINDOW`` neighbouring hashes the least is selected, the rightmost
of equal ones, and its position kept. Two texts that share ``GRAM + WINDOW - 1`` code points in a row therefore share a selected
hash, and its positions say where. A text shorter than a gram is one gram; one with fewer grams than a window is one window; an
empty text selects nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import in_order

GRAM, WINDOW = 20, 20
#: Odd multipliers of the rolling hash and of its last mixing.
BASE, SCRAMBLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD_BITS = np.uint64(32)
LAST = np.uint64((1 << 32) - 1)


class Roller:
    """Rolling hashes by sums of ``code * BASE ** position``, modulo 2 ** 64; the powers are kept between texts."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        size = max(size, 2 * len(self.powers))
        for name, base in (("powers", BASE), ("inverses", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def hashes(self, codes: np.ndarray, gram: int) -> np.ndarray:
        """32 bits for every run of ``gram`` codes."""
        n = len(codes)
        if n >= len(self.powers):
            self.grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64, out=sums[1:])
        mixed = (sums[gram:] - sums[:-gram]) * self.inverses[: n + 1 - gram]
        mixed ^= mixed >> WORD_BITS
        mixed *= np.uint64(SCRAMBLE)
        return mixed >> WORD_BITS


def least_of_runs(values: np.ndarray, run: int) -> np.ndarray:
    """The least of every ``run`` neighbours, by doubling."""
    size = 1
    while 2 * size <= run:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (run - size)], values[run - size :]) if run > size else values


def winnow(codes: np.ndarray, roller: Roller, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The selected hashes of a text's code points, and their positions, in order of position."""
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    hashes = roller.hashes(codes, min(gram, len(codes)))
    ranked = hashes << WORD_BITS | LAST - np.arange(len(hashes), dtype=np.uint64)  # the least hash, then the rightmost
    least = least_of_runs(ranked, min(window, len(ranked)))
    least = least[np.flatnonzero(np.append(True, least[1:] != least[:-1]))]
    return (least >> WORD_BITS).astype(np.uint32), (LAST - (least & LAST)).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct selected hashes of both that they have in common; 1 if neither has any."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def written(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each selected hash."""
    return hashes.astype(">u4").tobytes().hex()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_chars, fingerprint, positions`` of every row; a null text is empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            found = [winnow(code_points(text), roller, gram, window) for text in texts]
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([written(h) for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string, positions array<int>")


def from_last() -> list[Column]:
    """Descending doc_id, null ids at the end; rows of one id by the hash of their text."""
    return [F.col("doc_id").desc_nulls_last(), F.col("hash").desc()]


def place(doc_id: int | None, hash_: int) -> tuple:
    """Sorts like ``from_last``."""
    return doc_id is None, -(doc_id or 0), -hash_


def starts_of_runs(keys: DataFrame) -> list[tuple]:
    """The places where runs of about equal weight begin, one for each shuffle partition at most, the first row's among them."""
    ordered = in_order(keys, from_last(), "weight")
    step = max(1, -(-ordered.weight // max(1, len(ordered.starts))))
    after = F.col("before") + F.col("weight")
    crossing = F.expr(f"before div {step}") != F.floor(after / F.lit(step))
    rows = ordered.with_places("at", "before").where((F.col("at") == 0) | crossing).select("doc_id", "hash").collect()
    return sorted({place(r["doc_id"], r["hash"]) for r in rows})


def against_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every document beside its edited text and beside the next document.

    The next document is that of the next smaller doc_id, after the last the first. The edited text has the last half of the code points,
    rounded down, replaced by the first as many of the next document. Returns ``doc_id, n_chars, edited_sha256, fingerprint, positions,
    edited_fingerprint, edited_positions, near_edited, near_next``.

    A null text is empty; null ids come after all others; rows of one id follow in the order of a hash of their text, then of the
    text; a single document is its own next; an empty table gives no rows; other columns are ignored.

    Texts are shuffled once, into runs of that order. The places where runs begin are found beforehand on ids and hashes alone; a run's
    first document is also sent to the run before, which needs it as the next of its last.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    starts = starts_of_runs(texts.select("doc_id", "hash", (F.octet_length("text") + 64).cast("long").alias("weight")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, runs, extra = [], [], []
            for at, (doc_id, hash_) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist())):
                here = place(doc_id, hash_)
                run = bisect_right(starts, here) - 1
                rows.append(at)
                runs.append(run)
                extra.append(False)
                if starts[run] == here:
                    rows.append(at)
                    runs.append((run - 1) % len(starts))
                    extra.append(True)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(runs, pa.int32()), pa.array(extra, pa.bool_())], [*taken.schema.names, "run", "extra"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held = Roller(), None
        for batch in batches:
            out = []
            for at, (run, extra) in enumerate(zip(batch.column("run").to_pylist(), batch.column("extra").to_pylist())):
                if held is None and extra:
                    continue  # a further copy of a run's first document, or the rest of a run that has ended
                text = batch.column("text")[at].as_py()
                codes = code_points(text)
                found = winnow(codes, roller, gram, window)
                if held is not None:
                    doc_id, own, own_codes, selected = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    joined = np.concatenate([own_codes[: len(own) - half], codes[:half]])
                    changed = winnow(joined, roller, gram, window)
                    out.append((
                        doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), written(selected[0]), selected[1], written(changed[0]), changed[1],
                        likeness(selected[0], changed[0]), likeness(selected[0], found[0]),
                    ))
                held = None if extra else (batch.column("doc_id")[at].as_py(), text, codes, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "positions", "edited_fingerprint", "edited_positions", "near_edited", "near_next"]
    numbers = pa.list_(pa.int32())
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), numbers, pa.string(), numbers, pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, positions array<int>, edited_fingerprint string, edited_positions array<int>, near_edited double, near_next double"
    dealt = texts.mapInArrow(deal, "doc_id long, text string, hash long, run int, extra boolean")
    runs = dealt.repartitionById(max(1, len(starts)), "run").sortWithinPartitions("run", "extra", *from_last(), F.col("text").desc())
    return runs.mapInArrow(compare, schema)
