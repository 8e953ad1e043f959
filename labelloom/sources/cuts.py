"""Large CSV files, cut where records end although fields may hold line ends.

Tasks look at one block of a file each, without knowing whether it begins inside quotes, and note for both cases where its first
record ends. The number of quotes in the blocks before then tells which case it is. That holds where every quote opens a field, closes one
or is doubled; files with other quotes, or with unlike line ends, are named as not to be cut.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.sources.store import open_file

#: Bytes of a block.
BLOCK_BYTES = 32 << 20
#: Bytes of the records that go to the parser together.
BATCH_BYTES = 4 << 20
MARK = b"\xef\xbb\xbf"
QUOTE, COMMA, LINE, RETURN = b'",\n\r'
BESIDE = np.zeros(256, bool)
BESIDE[[QUOTE, COMMA, LINE, RETURN]] = True
SEEN = "path string, block long, quotes long, first array<long>, odd array<boolean>, bare array<boolean>, returned array<boolean>"


def look_at(octets: bytes, before: int, after: int) -> tuple[int, list, list, list, list]:
    """What a block shows if it begins outside, and if it begins inside quotes.

    Its number of quotes; then for either case the place after its first record (null: none ends), whether a quote or a
    carriage return is out of order, and whether records end in a bare line feed, or in one after a carriage return. ``before`` and
    ``after`` are the bytes next to the block; ends of the file count as line ends.
    """
    data = np.frombuffer(octets, np.uint8)
    wide = np.concatenate([[before], data, [after]]).astype(np.uint8)
    quotes, lines, returns = (np.flatnonzero(data == c) for c in (QUOTE, LINE, RETURN))
    place, lone = np.searchsorted(quotes, lines), returns[wide[returns + 2] != LINE]
    first, odd, bare, returned = [], [], [], []
    for inside in (0, 1):
        opens = (np.arange(len(quotes)) + inside) % 2 == 0
        ends = lines[(place + inside) % 2 == 0]
        after_return = wide[ends] == RETURN
        beside = np.where(opens, wide[quotes], wide[quotes + 2])
        first.append(int(ends[0]) + 1 if len(ends) else None)
        odd.append(bool((~BESIDE[beside]).any() or ((np.searchsorted(quotes, lone) + inside) % 2 == 0).any()))
        bare.append(bool((~after_return).any()))
        returned.append(bool(after_return.any()))
    return len(quotes), first, odd, bare, returned


def see_blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """A row for each block of the files ``path, length``."""
    count = F.expr(f"(length + {block_bytes - 1}) div {block_bytes}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, block in zip(batch["path"], batch["block"]):
                with open_file(path) as stream:
                    stream.seek(max(0, block * block_bytes - 1))
                    octets = stream.read(block_bytes + (2 if block else 1))
                before, octets = (octets[0], octets[1:]) if block else (LINE, octets)
                octets, after = octets[:block_bytes], octets[block_bytes] if len(octets) > block_bytes else LINE
                if not block and octets.startswith(MARK):
                    octets = b" " * (len(MARK) - 1) + b"," + octets[len(MARK) :]
                rows.append((path, block, *look_at(octets, before, after)))
            yield pd.DataFrame(rows, columns=["path", "block", "quotes", "first", "odd", "bare", "returned"])

    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    return blocks.repartition("path", "block").mapInPandas(run, SEEN)


def cut_places(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, low, high, whole, returned``: ranges of bytes that begin and end with records. With ``whole`` a file must not be cut, with
    ``returned`` its records end in a carriage return and a line feed.

    A block belongs with the records that begin in it after its first record end; a block in which none ends has no range. What a window
    holds are a few numbers for each block of one file.
    """
    order = Window.partitionBy("path").orderBy("block")
    seen = see_blocks(files, block_bytes).withColumn("inside", (F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).cast("int"))
    seen = seen.select("path", "block", "quotes", *[F.get(c, F.col("inside")).alias(c) for c in ("first", "odd", "bare", "returned")])
    kept = F.when(F.col("block") == 0, F.lit(0)).otherwise(F.col("block") * block_bytes + F.col("first")).alias("low")
    faults = seen.groupBy("path").agg((F.bool_or("odd") | (F.bool_or("bare") & F.bool_or("returned")) | (F.sum("quotes") % 2 == 1)).alias("whole"), F.bool_or("returned").alias("returned"))
    starts = seen.select("path", kept).where("low IS NOT NULL").join(faults, "path").join(files.select("path", "length"), "path").where("low < length")
    return starts.select("path", "low", F.coalesce(F.lead("low").over(Window.partitionBy("path").orderBy("low")), F.col("length")).alias("high"), "whole", "returned")


def records_of(octets: bytes) -> list[bytes]:
    """The records of a range, without their line ends and without empty ones."""
    data = np.frombuffer(octets, np.uint8)
    lines = np.flatnonzero(data == LINE)
    ends = lines[np.searchsorted(np.flatnonzero(data == QUOTE), lines) % 2 == 0].tolist()
    found = [octets[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(octets)])]
    return [r for r in (f[:-1] if f.endswith(b"\r") else f for f in found) if r]


def header_names(line: str | None) -> list[str] | None:
    """The column names of a header line; null if it ends inside quotes or names are empty or alike."""
    if not line or line.count('"') % 2:
        return None
    names = next(csv.reader([line]))
    return names if all(names) and len({n.lower() for n in names}) == len(names) else None


def read_cuts(cuts: DataFrame, tasks: int, names: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """The wanted columns, as strings, of the ranges ``path, low, high, returned`` of files whose header has ``names``.

    Tasks only cut the records apart; Spark's own parser takes them from there, with the options of its CSV source. Like that
    source, they make each line end of a field a line feed where records end in a carriage return and a line feed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in batch.to_pylist():
                with open_file(cut["path"]) as stream:
                    stream.seek(cut["low"])
                    found = records_of(stream.read(cut["high"] - cut["low"]))
                part, size = [], 0
                for record in found[1:] if cut["low"] == 0 else found:
                    part.append(record.replace(b"\r\n", b"\n") if cut["returned"] else record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["record"])
                        part, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["record"])

    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}
    records = cuts.select("path", "low", "high", "returned").repartition(tasks, "path", "low").mapInArrow(run, "record binary")
    parsed: Column = F.from_csv(F.decode("record", "UTF-8"), schema, options)
    return records.select(parsed.alias("r")).select(*[F.col("r")[n].alias(n) for n in wanted])
