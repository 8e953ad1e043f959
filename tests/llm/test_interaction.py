"""Filter interactions against all orders applied row by row."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from labelloom.llm import interaction

SCHEMA = "doc_id long, text string, source string, part string, row int, A string, first int, good int"


def plain_failures(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        out.append((
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search("[#$%&*|]", text)), doc_id is not None and first[text] < doc_id,
        ))
    return out


def plain_audit(rows, fails, marks, filters):
    out = set()
    for part in {r[2] or "" for r in rows}:
        own = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        steps, shapley = [], Counter()
        for order in permutations(range(len(filters))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                all_failing = sum(fails[i][f] for i in own)
                unique = sum(fails[i][f] and sum(fails[i]) == 1 for i in own)
                shapley[f] += len(gone)
                lost = [sum(marks[i][m] for i in gone) for m in range(2)]
                steps.append((f, (part, "".join(filters[g] for g in order), step, len(left), len(gone), all_failing - len(gone), unique, *lost)))
        out |= {(*row, shapley[f]) for f, row in steps}
    return out


def varied():
    rng = random.Random(2)
    many = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(many + ["A", "BIG"] * (i % 3)) for _ in range(rng.choice([5, 190, 200, 260, 420]))) + rng.choice(["", "", " #", " |", "\x0b\té"])
        rows.append((i, text, rng.choice(["s0", "s0", "s0", "s1", None, ""])))
    rows += [(400 + i, rows[7 * i][1], "s1") for i in range(20)] + [(3, rows[3][1], "s0")] * 2
    rows += [(None, rows[0][1], "s0"), (None, "x", "s2"), (500, None, "s3"), (501, "", "s3"), (502, " \n", "s3"), (503, "é" * 20000, "s4"), (504, "A" * 20000, "s4")]
    return rows


def test_audit(spark, monkeypatch):
    rows = varied()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 3)] + [(0, 1, 1), (3, None, None), (None, 1, 1), (9999, 1, 1)]
    said = {}
    for i, quality, toxic in labels:
        good, bad = said.get(i, (False, False))
        said[i] = (good or quality == 1, bad or toxic == 1)
    marks = [said.get(i, (False, False)) if i is not None else (False, False) for i, *_ in rows]
    wanted = plain_audit(rows, plain_failures(rows), marks, "ABCDE")
    docs = spark.createDataFrame([(*r, "p", 1, "a", 2, 3) for r in rows], SCHEMA).repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for width in (interaction.RANGE, 16):
        monkeypatch.setattr(interaction, "RANGE", width)
        found = interaction.audit(docs, table)
        assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) == 6 * 600 and set(got) == wanted


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "no", None, "p", 1, "a", 2, 3)], SCHEMA)
    rows = interaction.audit(one, labels).collect()
    assert len(rows) == 600 and {(r.part, r.good_lost, r.toxic_lost) for r in rows} == {("", 0, 0)}


def test_own_filters(spark):
    rows = spark.createDataFrame([("a", True, None, True), ("a", True, True, None), (None, None, None, None)], "part string, x boolean, `y z` boolean, hit boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.hit_lost, r.shapley) for r in interaction.interactions(rows, "part", ["x", "y z"], ["hit"]).collect()}
    assert got["a", "xy z", 1] == (0, 2, 0, 1, 1, 3) and got["a", "y zx", 2] == (0, 1, 1, 1, 1, 3)
    assert got["", "xy z", 2] == (1, 0, 0, 0, 0, 0) and len(got) == 8
    with pytest.raises(ValueError):
        interaction.interactions(rows, "part", list("abcdefgh"))


def test_galloping_merges(monkeypatch):
    rng = np.random.default_rng(1)
    for block in (1024, 3):
        monkeypatch.setattr(interaction, "BLOCK", block)
        for _ in range(200):
            lists = [np.unique(rng.integers(0, rng.choice([20, 5000]), rng.choice([0, 1, 7, 400]))) for _ in range(4)]
            assert interaction.union(lists).tolist() == sorted(set().union(*map(np.ndarray.tolist, lists)))
            assert interaction.without(lists[0], lists[1]).tolist() == sorted(set(lists[0].tolist()) - set(lists[1].tolist()))
            start, bound = int(rng.integers(0, len(lists[0]) + 1)), int(rng.integers(0, 5100))
            assert interaction.gallop(lists[0], start, bound) == max(start, int(np.searchsorted(lists[0], bound)))
