"""Areas, metrics and blending against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import blend as bl, metrics as mt


def _auc(truth, score):
    pos = [s for t, s in zip(truth, score) if t]
    neg = [s for t, s in zip(truth, score) if not t]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id int, candidate string, label string, score double, truth int")


@pytest.fixture(scope="module")
def cube():
    random.seed(4)
    truth = {(i, label): int(random.random() < p) for i in range(300) for label, p in (("x", 0.3), ("y", 0.1))}
    rows = []
    for (i, label), t in truth.items():
        rows.append((i, "good", label, min(1.0, max(0.0, random.gauss(0.3 + 0.2 * t, 0.2))), t))
        rows.append((i, "coarse", label, round(random.gauss(0.5 + 0.2 * t, 0.2), 1), t))
        rows.append((i, "noise", label, random.random(), t))
    return rows


def test_roc_auc(spark, cube):
    found = {(r["candidate"], r["label"]): r["roc_auc"] for r in mt.roc_auc(_scored(spark, cube)).collect()}
    for key in found:
        mine = [(t, s) for _, c, label, s, t in cube if (c, label) == key]
        assert found[key] == pytest.approx(_auc(*zip(*mine)), abs=1e-12)


def test_roc_auc_ignores_monotone_transforms(spark, cube):
    scored = _scored(spark, cube)
    moved = scored.withColumn("score", F.exp(F.col("score") * 5) - 40)
    key = lambda df: sorted((r["candidate"], r["label"], round(r["roc_auc"], 12)) for r in mt.roc_auc(df).collect())
    assert key(scored) == key(moved)


def test_one_outcome_has_no_area(spark):
    rows = [(1, "c", "x", 0.1, 0), (2, "c", "x", 0.9, 0), (1, "c", "y", 0.1, 0), (2, "c", "y", 0.9, 1)]
    auc = mt.roc_auc(_scored(spark, rows))
    assert {r["label"]: r["roc_auc"] for r in auc.collect()} == {"x": None, "y": 1.0}
    assert mt.mean_column_auc(auc).first()["mean_column_roc_auc"] == 1.0


def test_metrics_are_zero_when_undefined(spark):
    rows = [(1, "c", "x", 0.1, 1), (2, "c", "x", 0.2, 0), (1, "c", "y", 0.5, 1), (2, "c", "y", 0.49, 0)]
    table = mt.all_metrics(_scored(spark, rows), "id").first().asDict()
    assert table["macro_precision"] == 0.5 and table["macro_f1"] == 0.5
    assert table["element_wise_accuracy"] == 0.75 and table["subset_accuracy"] == 0.5
    assert table["micro_precision"] == 1.0 and table["micro_recall"] == 0.5


def test_pool(spark):
    pool = bl.weight_pool(6)
    assert len(pool) == 436
    assert np.allclose(np.sum(pool, axis=1), 1.0) and np.min(pool) >= 0


def _alike():
    """Weights so near to one another that a grid of 2,048 cells cannot tell them apart, the first of them four times."""
    near = [[0.6 + k * 2e-3, 0.3 - k * 2e-3, 0.1] for k in range(20)]
    return [near[7]] * 4 + near


@pytest.mark.parametrize("mode", ["global", "per-label"])
@pytest.mark.parametrize("pool", [bl.weight_pool(3, 0), bl.weight_pool(3, 60, seed=9), _alike()], ids=["fixed", "drawn", "alike"])
def test_search_equals_measuring_everything(spark, cube, mode, pool, monkeypatch):
    candidates, batches = ["good", "coarse", "noise"], []
    monkeypatch.setattr(bl, "MEASURED", 3)
    monkeypatch.setattr(bl, "_batches", lambda rows, goal, cut=bl._batches: batches.extend(cut(rows, goal)) or batches)
    ranks = bl.fractional_ranks(_scored(spark, cube), "id")
    found = bl.search_weights(ranks, "id", candidates, bl.pool_table(spark, pool), mode).collect()
    fraction = {(r["id"], r["label"], r["candidate"]): r["fraction"] for r in ranks.collect()}
    truth = {(i, label): t for i, _, label, _, t in cube}

    def area(weights, label):
        ids = [i for i, name in truth if name == label]
        blended = [sum(fraction[i, label, c] * w for c, w in zip(candidates, weights)) for i in ids]
        return _auc([truth[i, label] for i in ids], blended)

    areas = [{label: area(w, label) for label in ("x", "y")} for w in pool]
    for batch in batches:  # a job never measures more pool rows of a label than it may
        assert max(Counter(r["label"] if mode == "per-label" else None for r in batch).values()) <= 3
    assert sum(map(len, batches)) < len(pool) * (1 if mode == "global" else 2)
    if mode == "global":
        best = max(range(len(pool)), key=lambda p: (np.mean(list(areas[p].values())), -p))
        assert [(r["pool_id"]) for r in found] == [best]
    else:
        for label in ("x", "y"):
            best = max(range(len(pool)), key=lambda p: (areas[p][label], -p))
            assert [r["pool_id"] for r in found if r["label"] == label] == [best]


def test_apply_weights_and_audit(spark, cube):
    scored = _scored(spark, cube)
    weights = spark.createDataFrame(
        [(label, c, w) for label in ("x", "y") for c, w in (("good", 0.75), ("coarse", 0.25), ("noise", 0.0))],
        "label string, candidate string, weight double",
    )
    assert bl.check_weights(weights).first()["labels_off_one"] == 0
    blended = bl.apply_weights(scored, weights, "id", keep=["truth"]).collect()
    assert len(blended) == 600 and all(0 < r["score"] < 1 for r in blended)
    same = spark.createDataFrame([(0.7,)], "mean_column_roc_auc double")
    assert bl.audit_blend(same, same).first()["accepted"] is False


def test_blend_weights_table(spark):
    found = spark.createDataFrame([(0, 0.4, 0.6, 0.9)], "pool_id int, w0 double, w1 double, roc_auc double")
    table = bl.blend_weights_table(found, ["p", "q"], ["x", "y"])
    assert {(r["label"], r["candidate"]): r["weight"] for r in table.collect()} == {
        key: w for key, w in zip(itertools.product("xy", "pq"), [0.4, 0.6] * 2)
    }


def test_finer_grids_leave_only_what_ties(spark, cube):
    candidates = ["good", "coarse", "noise"]
    ranks = bl.fractional_ranks(_scored(spark, cube), "id")
    wide, pool = bl.wide_ranks(ranks, "id", candidates, keep=["truth"]).cache(), bl.pool_table(spark, _alike())
    scores = bl._met(wide, pool, None, [], 3)
    left = [bl._open_rows(scores, [], grid).count() for grid in (64, *(bl.GRID * bl.FINER**k for k in range(bl.GRIDS)))]
    assert left == sorted(left, reverse=True) and left[0] > left[-1]
    assert left[0] > bl.MEASURED >= left[-1]


def test_search_without_two_outcomes_finds_nothing(spark):
    rows = [(i, c, "x", i / 5, 0) for i in range(5) for c in ("a", "b")]
    ranks = bl.fractional_ranks(_scored(spark, rows), "id")
    assert bl.search_weights(ranks, "id", ["a", "b"], bl.pool_table(spark, bl.weight_pool(2, 3))).count() == 0
