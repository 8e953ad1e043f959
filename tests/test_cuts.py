"""Files cut into blocks against the same files read in one task."""

import random

import numpy as np
import pytest
from pyspark.sql.types import StringType, StructField, StructType

from labelloom.sources import cuts, files

SCHEMA = StructType([StructField(c, StringType()) for c in ("id", "text", "note")])


def table(seed, end, rows=60):
    """Fields with commas, doubled quotes, line ends and long runs of them."""
    rng, out = random.Random(seed), ["id,text,extra,note"]
    bits = ["a", "é", ",", '""', end, " ", '"",""', f'{end}7,"",""x"",{end}', "word " * 9, end * 5, "\r\n", "\r"]
    for i in range(rows):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        plain = rng.choice(["", "x y", "NA", "z" * rng.randrange(30)])
        out.append(rng.choice([f'{i},"{text}",,{plain}', f'"{i}",{plain},"{text}","{text}"', f"{i},short", "", f'{i},"",x,y,z']))
    return out


def both(spark, paths, block_bytes):
    cut = files.read_csv_table(spark, paths, SCHEMA, block_bytes=block_bytes)
    return sorted(map(tuple, cut.collect()), key=str), sorted(map(tuple, files.read_csv_table(spark, paths, SCHEMA).collect()), key=str), cut


@pytest.mark.parametrize(("end", "block", "mark"), [("\n", 7, b""), ("\r\n", 64, b""), ("\n", 300, cuts.MARK)])
def test_cut_files_equal_whole_ones(spark, tmp_path, end, block, mark):
    for seed in range(3):
        (tmp_path / f"{seed}.csv").write_bytes(mark + (end.join(table(seed, end)) + end * (seed % 2)).encode())
    got, want, frame = both(spark, [str(tmp_path)], block)
    assert got == want and len(got) > 100 and frame.rdd.getNumPartitions() > 3


@pytest.mark.parametrize("line", ['5,3" pipe,x,y', '5,"open,x,y', '5,"a"b,x,y', "5,a\rb,x,y", "5,mixed,x,y\r"])
def test_irregular_files_take_one_task(spark, tmp_path, line):
    lines = table(9, "\n")
    (tmp_path / "odd.csv").write_text("\n".join([*lines[:30], line, *lines[30:]]), newline="")
    sizes = files.list_files(spark, [str(tmp_path)])
    assert {r.whole for r in cuts.cut_places(sizes, 100).collect()} == {True}
    got, want, _ = both(spark, [str(tmp_path)], 100)
    assert got == want


def test_ranges_meet_and_follow_the_records(spark, tmp_path):
    body = "\n".join(table(4, "\n")).encode()
    (tmp_path / "a.csv").write_bytes(body)
    (tmp_path / "one_record.csv").write_bytes(b'id,text,note\n1,"' + b"x\n" * 500 + b'",y')
    places = cuts.cut_places(files.list_files(spark, [str(tmp_path)]), 50).orderBy("path", "low").collect()
    first = [(r.low, r.high) for r in places if r.path.endswith("/a.csv")]
    assert first[0][0] == 0 and first[-1][1] == len(body) and all(a[1] == b[0] for a, b in zip(first, first[1:]))
    assert [r for low, high in first for r in cuts.records_of(body[low:high])] == cuts.records_of(body)
    assert [(r.low, r.high) for r in places if "one_record" in r.path] == [(0, 1019)]


def test_a_block_looked_at_both_ways():
    octets = b'a,"b\n""c"\nd\r\n"'
    quotes, first, odd, bare, returned = cuts.look_at(octets, cuts.LINE, cuts.LINE)
    assert quotes == 5 and first == [10, 5] and odd == [False, True] and bare == [True, True] and returned == [True, False]
    assert cuts.look_at(b"", cuts.LINE, cuts.LINE) == (0, [None, None], [False, False], [False, False], [False, False])
    assert cuts.header_names('id,"a,b"') == ["id", "a,b"] and cuts.header_names('id,"a') is None and cuts.header_names("a,A") is None
    assert np.array_equal(cuts.records_of(b'1,"x\n"\r\n\r\n2,y'), [b'1,"x\n"', b"2,y"])
