"""Features, fits and the assembled experiment."""

import os
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import RDD
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.operators import adapter as adapter_module, features as ft, linear, metrics as mt, mlp, profile, vectors as vec
from labelloom.operators.adapter import apply_adapter, fit_adapter
from labelloom.operators.linear import LOGISTIC, SQUARED_HINGE, curvature, fit_linear, loss_and_slope, score_linear
from labelloom.operators.mlp import fit_mlp, loss_and_gradient, score_multi
from labelloom.plans import experiment as ex
from labelloom.staging import shared_folder, stage

RNG = np.random.default_rng(3)
ROWS, FEATURES, LABELS = 240, 30, ["x", "y"]
MATRIX = RNG.standard_normal((ROWS, FEATURES)) * (RNG.random((ROWS, FEATURES)) < 0.3)
MATRIX[0] = 0.0  # a row without a known term
DENSE_Y = np.column_stack(
    [MATRIX[:, :5].sum(axis=1) + 0.3 * RNG.standard_normal(ROWS) > 0.5, MATRIX[:, 5:9].sum(axis=1) > 0.8]
).astype(int)


@pytest.fixture(scope="module")
def vectors(spark):
    rows = []
    for i, values in enumerate(MATRIX):
        used = np.flatnonzero(values)
        rows.append((i, *map(int, DENSE_Y[i]), used.tolist(), values[used].tolist()))
    schema = "id int, x int, y int, indices array<int>, values array<double>"
    return spark.createDataFrame(rows, schema).repartition(5).persist()


@pytest.mark.parametrize("loss", [LOGISTIC, SQUARED_HINGE])
def test_linear_fit_is_optimal(vectors, loss):
    cost = {"x": 2.0, "y": 0.5}
    model = fit_linear(vectors, LABELS, FEATURES, loss, cost, balanced=["y"], tolerance=1e-7)
    with_one = np.column_stack([MATRIX, np.ones(ROWS)])
    for i, label in enumerate(LABELS):
        sign = 2.0 * DENSE_Y[:, i] - 1
        pos = DENSE_Y[:, i].sum()
        c = np.full(ROWS, cost[label])
        if label == "y":
            c *= np.where(sign > 0, ROWS / (2 * pos), ROWS / (2 * (ROWS - pos)))

        def objective(w):
            row_loss, slope = loss_and_slope(loss, with_one @ w, sign)
            return c @ row_loss + w @ w / 2, with_one.T @ (c * slope) + w

        value, gradient = objective(model.weights[:, i])
        # The objective is 1-strongly convex, so the gradient bounds the distance to the minimum.
        assert np.linalg.norm(gradient) < 1e-4
        numeric = [
            (objective(model.weights[:, i] + e)[0] - objective(model.weights[:, i] - e)[0]) / 2e-4
            for e in 1e-4 * np.eye(FEATURES + 1)[:4]
        ]
        assert np.allclose(numeric, gradient[:4], atol=1e-3)


def test_linear_scores(vectors):
    model = fit_linear(vectors, LABELS, FEATURES, SQUARED_HINGE, dict.fromkeys(LABELS, 1.0))
    scored = score_linear(vectors, model, ["id"], "svm")
    rows = {(r["id"], r["label"]): r["score"] for r in scored.collect()}
    margin = np.column_stack([MATRIX, np.ones(ROWS)]) @ model.weights
    assert rows[7, "y"] == pytest.approx(0.5 + np.arctan(margin[7, 1]) / np.pi)
    assert min(r["roc_auc"] for r in mt.roc_auc(scored).collect()) > 0.9


def test_the_sample_of_a_fit_stays_off_the_driver(vectors, monkeypatch):
    """What a fit collects is a few weights per label, never rows."""
    taken = []
    collect = RDD.collect

    def watched(rdd):
        got = collect(rdd)
        taken.append(sum(np.size(array) for item in got if isinstance(item, tuple) for array in item))
        return got

    monkeypatch.setattr(RDD, "collect", watched)
    fit_linear(vectors, LABELS, FEATURES, LOGISTIC, dict.fromkeys(LABELS, 1.0))
    assert max(taken) <= 5 * len(LABELS) * (FEATURES + 3) < np.count_nonzero(MATRIX)


def test_a_sample_of_few_rows_does_not_make_many_passes(spark, monkeypatch):
    """Frequent and rare features, of which a sample shows some too strongly and others not at all."""
    rows, features, entries = 4000, 3000, 40
    rng = np.random.default_rng(5)
    chance = np.arange(1, features + 1) ** -0.8
    index = np.stack([np.sort(rng.choice(features, entries, False, chance / chance.sum())) for _ in range(rows)])
    matrix = np.zeros((rows, features + 1))
    np.put_along_axis(matrix, index, entries**-0.5, axis=1)
    matrix[:, features] = 1.0
    outcome = matrix[:, :features] @ rng.standard_normal(features) + 0.5 * rng.standard_normal(rows) > 0.8
    value = [float(entries**-0.5)] * entries
    table = spark.createDataFrame(
        [(i, int(outcome[i]), index[i].tolist(), value) for i in range(rows)], "id int, x int, indices array<int>, values array<double>"
    ).repartition(4).persist()
    monkeypatch.setattr(linear, "SAMPLE_ROWS", 1200)
    sign, cost = 2.0 * outcome - 1, 2.0
    for loss, most in ((SQUARED_HINGE, 45), (LOGISTIC, 25)):
        model = fit_linear(table, ["x"], features, loss, {"x": cost})
        assert model.passes <= most

        def gradient(w):
            return cost * matrix.T @ loss_and_slope(loss, matrix @ w, sign)[1] + w

        assert np.linalg.norm(gradient(model.weights[:, 0])) <= 1.001e-4 * np.linalg.norm(gradient(np.zeros(features + 1)))
    table.unpersist()


@pytest.mark.parametrize("trial", [(0.4, 3.0), (0.4, -0.5)])
def test_the_next_length_lies_inside_the_interval(trial):
    """At the zero of the line through two slopes, or half way while the value rises and the slope does not."""
    assert linear._next_length((0.0, -1.0), trial) == pytest.approx(0.1 if trial[1] > 0 else 0.2)
    assert linear._next_length((0.2, -1.0), (0.4, 1e6)) == pytest.approx(0.21)


def test_recent_moves_lie_in_a_file():
    moves = linear.Moves(3, 2)
    for k in range(4):
        moves.add(np.full(3, float(k)), np.arange(3.0) + k)
    assert [(move[0], change[2]) for move, change in moves.pairs()] == [(2.0, 4.0), (3.0, 5.0)]
    assert [move[0] for move, _ in moves.pairs(latest_first=True)] == [3.0, 2.0]
    moves.clear()
    moves.add(np.full(3, 9.0), np.zeros(3))
    assert [move[0] for move, _ in moves.pairs()] == [9.0]


def test_long_rows_come_in_small_blocks(vectors, monkeypatch):
    """Blocks are bounded by their entries; rows without any and the fit stay as they are."""
    whole = fit_linear(vectors, LABELS, FEATURES, SQUARED_HINGE, dict.fromkeys(LABELS, 1.0), tolerance=1e-8)
    monkeypatch.setattr(vec, "BLOCK_ENTRIES", 20)
    with vec.row_blocks(vectors, LABELS, ROWS) as blocks:
        sizes = blocks.map(lambda block: (len(block[0]), len(block[1]))).collect()
    assert sum(rows for rows, _ in sizes) == ROWS and sum(n for _, n in sizes) == np.count_nonzero(MATRIX)
    assert all(n <= 20 or rows == 1 for rows, n in sizes)
    cut = fit_linear(vectors, LABELS, FEATURES, SQUARED_HINGE, dict.fromkeys(LABELS, 1.0), tolerance=1e-8)
    assert np.allclose(whole.weights, cut.weights, atol=1e-6)
    assert vec.run_sums(np.arange(4.0), np.array([0, 3, 0, 1, 0])).tolist() == [0, 3, 0, 3, 0]


def test_one_outcome_is_refused(vectors):
    with pytest.raises(ValueError, match="one outcome"):
        fit_linear(vectors.withColumn("x", F.lit(0)), LABELS, FEATURES, LOGISTIC, dict.fromkeys(LABELS, 1.0))


def test_svd_on_the_side_of_the_rows(spark, vectors):
    """Wider than long: the same directions and scaling as those of a plain decomposition."""
    few = 24
    wide = vectors.where(f"id < {few}").repartition(4)
    adapter = fit_adapter(wide, FEATURES, few, components=8, iterations=8)
    _, singular, right = np.linalg.svd(MATRIX[:few], full_matrices=False)
    assert np.allclose(adapter.singular_values, singular[:8], rtol=1e-3)
    assert np.allclose(np.abs((adapter.directions * right[:8].T).sum(axis=0)), 1, atol=1e-2)
    reduced = MATRIX[:few] @ adapter.directions
    assert np.allclose(adapter.mean, reduced.mean(axis=0), atol=1e-5) and np.allclose(adapter.deviation, reduced.std(axis=0), rtol=1e-4)


def test_turned_blocks(vectors, monkeypatch):
    monkeypatch.setattr(vec, "DENSE", 100)
    with vec.row_blocks(vectors, [], 512 * 3, written=True) as blocks:
        order = np.concatenate([rows.reshape(-1) for rows in blocks.map(lambda b: b[0]).collect()])
        turned = vec.turned_blocks(blocks, FEATURES).collect()
        dense = np.concatenate([d @ np.ones(d.shape[1]) for b in blocks.collect() for _, d in vec.rows_of(b).blocks()])
    found = np.zeros((FEATURES, ROWS))
    for lengths, rows, values, used in turned:
        found[np.repeat(used, lengths), rows] = values
    assert sorted(np.count_nonzero(found, axis=0)) == sorted(order)
    assert np.allclose(found.sum(axis=0), dense) and np.allclose(np.sort(found.sum(axis=1)), np.sort(MATRIX.sum(axis=0)))


def test_svd_and_scaling(vectors):
    adapter = fit_adapter(vectors, FEATURES, ROWS, components=8, iterations=6)
    _, singular, right = np.linalg.svd(MATRIX, full_matrices=False)
    assert np.allclose(adapter.singular_values, singular[:8], rtol=1e-3)
    reduced = MATRIX @ adapter.directions
    assert np.allclose(adapter.mean, reduced.mean(axis=0)) and np.allclose(adapter.deviation, reduced.std(axis=0))
    assert adapter.explained_variance == pytest.approx(reduced.var(axis=0).sum() / MATRIX.var(axis=0).sum())
    dense = np.array([r["features"] for r in apply_adapter(vectors, adapter, ["id"]).orderBy("id").collect()])
    assert np.allclose(dense, (reduced - adapter.mean) / adapter.deviation, atol=1e-4)
    with pytest.raises(ValueError, match="Too few"):
        fit_adapter(vectors, 8, ROWS)


@pytest.mark.parametrize("few", [24, ROWS])
def test_directions_stay_on_the_executors(vectors, monkeypatch, few):
    """In pieces of seven rows: the same directions, and no array on the driver grows with the features."""
    monkeypatch.setattr(adapter_module, "PIECE", 7)
    adapter = fit_adapter(vectors.where(f"id < {few}"), FEATURES, few, components=8, iterations=8)
    held = [value for value in vars(adapter).values() if isinstance(value, np.ndarray)]
    assert held and max(value.size for value in held) == 8
    _, singular, right = np.linalg.svd(MATRIX[:few], full_matrices=False)
    assert np.allclose(adapter.singular_values, singular[:8], rtol=1e-3)
    reduced = MATRIX[:few] @ adapter.directions
    dense = np.array([r["features"] for r in apply_adapter(vectors.where(f"id < {few}"), adapter, ["id"]).orderBy("id").collect()])
    assert np.allclose(dense, (reduced - adapter.mean) / adapter.deviation, atol=1e-4)


@pytest.mark.parametrize("few", [24, ROWS])
def test_a_task_holds_some_columns_of_a_basis(vectors, monkeypatch, few):
    """Four slices of a basis in pieces of seven rows give the same directions; no task makes an array of all columns."""
    monkeypatch.setattr(adapter_module, "PIECE", 7)
    monkeypatch.setattr(adapter_module, "SLICE", min(few, FEATURES) * 18 // 4 + 1)
    products, widths = adapter_module._beside, []
    monkeypatch.setattr(adapter_module, "_beside", lambda pieces, data: widths.append(pieces.first()[1].shape[1]) or products(pieces, data))
    adapter = fit_adapter(vectors.where(f"id < {few}"), FEATURES, few, components=8, iterations=8)
    _, singular, right = np.linalg.svd(MATRIX[:few], full_matrices=False)
    assert np.allclose(adapter.singular_values, singular[:8], rtol=1e-3)
    assert np.allclose(np.abs((adapter.directions * right[:8].T).sum(axis=0)), 1, atol=1e-2)
    assert max(widths) <= 8 and sum(widths) >= 10 * 18


def test_turned_rows_are_multiplied_dense_or_one_by_one(monkeypatch):
    monkeypatch.setattr(vec, "BLOCK_ENTRIES", 20)
    monkeypatch.setattr(vec, "DENSE", 3 * ROWS)
    monkeypatch.setattr(adapter_module, "DENSE_SHARE", 0.3)
    feature, row = np.nonzero(MATRIX.T)
    lengths = np.bincount(feature, minlength=FEATURES)
    block = lengths, row.astype(np.int32), MATRIX.T[feature, row].astype(np.float32), np.arange(FEATURES)
    parts = list(adapter_module._turned_parts(block, ROWS))
    assert {len(part) for part in parts} == {2, 4} and sorted(np.concatenate([p[0] for p in parts])) == list(range(FEATURES))
    columns, total = RNG.standard_normal((ROWS, 4)).astype(np.float32), np.zeros((ROWS, 4))
    adapter_module._add_turned(block, columns, total)
    assert np.allclose(total, MATRIX @ (MATRIX.T @ columns), atol=1e-3)


def test_fits_at_a_time_share_the_cores(vectors, monkeypatch):
    """Partitions answer with sums of full size, so three fits at a time must not have three times as many."""
    made = []
    blocks = linear.row_blocks
    monkeypatch.setattr(linear, "row_blocks", lambda *a, **b: made.append(b["most"]) or blocks(*a, **b))
    for at_once in (1, 3):
        fit_linear(vectors, LABELS, FEATURES, LOGISTIC, dict.fromkeys(LABELS, 1.0), at_once=at_once)
    assert made[1] == max(1, made[0] // 3)


def test_large_records_are_not_held_by_the_hundred(spark):
    """Parquet looked at the size of a row group after a hundred records."""
    rows = spark.range(12, numPartitions=1).select(F.expr("cast(repeat(string(id), 4000000) AS binary) AS piece"))
    groups = [pq.ParquetFile(path).metadata.num_row_groups for path in stage(rows, "pieces", large=True).inputFiles() for path in [path.removeprefix("file://")]]
    assert groups and min(groups) > 1


def test_svd_of_equal_rows(vectors):
    """A span that is not of full rank: copies of four rows have four directions."""
    copies = vectors.where("id BETWEEN 1 AND 4").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(15))))
    adapter = fit_adapter(copies, FEATURES, 60, components=8, iterations=2)
    singular = np.linalg.svd(np.repeat(MATRIX[1:5], 15, axis=0), compute_uv=False)
    assert np.allclose(adapter.singular_values, singular[:8], rtol=1e-3, atol=1e-2)


def test_large_sums_are_added_up_on_the_executors(spark, monkeypatch):
    """The driver receives one sum, not one a partition."""
    received, collect, size = [], RDD.collect, 100_000
    monkeypatch.setattr(RDD, "collect", lambda rdd: received.append(collect(rdd)) or received[-1])
    total = vec.sum_partials(spark.sparkContext.parallelize(range(8), 8), lambda part: np.full(size, float(sum(part))), size)
    assert (total == 28).all()
    assert sum(len(values) for found in received for _, values in found) == size


def test_rows_are_encoded_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ft, "ROWS_AT_ONCE", 2)
    encode_rows = ft.encode_rows

    def bounded(term_lists, terms, idf):
        assert len(term_lists) <= 2
        return encode_rows(term_lists, terms, idf)

    monkeypatch.setattr(ft, "encode_rows", bounded)
    rows = spark.createDataFrame([(i, ["a"] * i + ["b"]) for i in range(5)], "id int, terms array<string>").coalesce(1)
    found = ft.encode(rows, ft.Encoder(pa.array(["a", "b"]), None), ["id"]).orderBy("id").collect()
    assert [(r["id"], r["indices"]) for r in found] == [(0, [1]), *((i, [0, 1]) for i in range(1, 5))]


def test_targets_are_encoded_once_for_all_families(spark, corpus, monkeypatch):
    held = []

    def fit(train, targets, encoder, rows, representation, family, settings, seed_offset, truth):
        held.extend(target.storageLevel.useMemory for target in targets.values())
        key = ex.candidate_key(representation, family)
        return {name: spark.createDataFrame([(1, key)], "id int, candidate string") for name in targets}, {}

    monkeypatch.setattr(ex, "fit_family", fit)
    ex.fit_and_score(corpus, {"same": corpus}, SETTINGS)
    assert held == [True] * 6


def test_network_gradient():
    shape = (4, 3, 2)
    flat = RNG.standard_normal(4 * 3 + 3 + 3 * 2 + 2)
    x, y, w = RNG.standard_normal((9, 4)), RNG.integers(0, 2, (9, 2)), RNG.random(9) + 0.5
    _, gradient = loss_and_gradient(flat, shape, x, y, w, 0.1)
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-5
        numeric = (loss_and_gradient(flat + e, shape, x, y, w, 0.1)[0] - loss_and_gradient(flat - e, shape, x, y, w, 0.1)[0]) / 2e-5
        assert numeric == pytest.approx(gradient[i], abs=1e-6)


@pytest.mark.parametrize("shards", [1, 8])
def test_network_learns(spark, shards, monkeypatch):
    monkeypatch.setattr(mlp, "BLOCK_ROWS", 50)
    rows = [(i, *map(int, DENSE_Y[i]), MATRIX[i].tolist()) for i in range(ROWS)]
    dense = spark.createDataFrame(rows, "id int, x int, y int, features array<float>").persist()
    options = dict(components=FEATURES, units=16, batch=32, rate=0.01, shards=shards)
    short = fit_mlp(dense, LABELS, "id", max_epochs=1, **options)
    long = fit_mlp(dense, LABELS, "id", max_epochs=15, **options)
    assert long.final_loss < short.final_loss and long.epochs == 15 and long.reached_epoch_budget
    for parts in (2, 8):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(7 * parts))
        again = fit_mlp(dense.repartition(parts), LABELS, "id", max_epochs=15, **options)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert np.allclose(long.hidden, again.hidden)
    assert min(r["roc_auc"] for r in mt.roc_auc(score_multi(dense, long, ["id"], "net")).collect()) > 0.9


def test_encode_rows_counts_repeats_and_drops_unknown_terms():
    lists = pa.array([["b", "a", "b"], [], ["zzz"], ["c"]], pa.list_(pa.string()))
    idf = np.array([1.0, 2.0, 3.0])
    ends, index, values = ft.encode_rows(lists, pa.array(["a", "b", "c"]), idf)
    assert ends.tolist() == [0, 2, 2, 2, 3] and index.tolist() == [0, 1, 2]
    raw = np.array([1.0, (1 + np.log(2)) * 2])
    assert np.allclose(values, [*raw / np.linalg.norm(raw), 1.0])
    assert np.allclose(ft.encode_rows(lists, pa.array(["a", "b", "c"]), None)[2], [2**-0.5, 2**-0.5, 1.0])


def test_transform_with_unknown_terms(spark):
    words = replace(ft.WORD_TFIDF, min_df=1, max_df=1.0)
    fitted = spark.createDataFrame([(1, "red green"), (2, "red")], "id int, text string")
    vocab = ft.vocabulary(ft.term_counts(ft.with_terms(fitted, "text", words), False), 2, 1, 1.0, 10)
    assert [(r["term_idx"], r["term"], r["tf"], r["df"]) for r in vocab.orderBy("term_idx").collect()] == [
        (0, "green", 1, 1), (1, "red", 2, 2), (2, "red green", 1, 1),
    ]
    fresh = spark.createDataFrame([(7, "blue"), (8, "Rëd blue red")], "id int, text string")
    rows = ft.transform_with(fresh, ft.with_idf(vocab, 2), "id", "text", words).collect()
    assert {(r["id"], r["term"], r["value"]) for r in rows} == {(7, None, None), (8, "red", 1.0)}


@pytest.fixture(scope="module")
def corpus(spark):
    """Every label has its own words; each text but a few occurs once."""
    rng = np.random.default_rng(11)
    common = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(160):
        x, y = int(i % 4 == 0), int(i % 5 == 0)
        words = list(rng.choice(common, 12)) + ["awful"] * x + ["spam spam"] * y
        rng.shuffle(words)
        rows.append((i, " ".join(words), x, y))
    rows += [(200 + i, rows[i][1].upper(), rows[i][2], rows[i][3]) for i in range(20)]
    return spark.createDataFrame(rows, "id int, text string, x int, y int")


SETTINGS = ex.Settings(
    "id", "text", ("x", "y"),
    representations=(replace(ft.WORD_TFIDF, max_features=500), replace(ft.CHAR_NGRAMS, max_features=800)),
    components=10, epochs=3, tolerance=1e-3,
)


def test_cross_validation(spark, corpus):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    split = ex.split_rows(corpus, 2, SETTINGS)
    assert len(set(os.listdir(folder)) - before) == 1
    crossing = split.groupBy("group_key").agg(F.count_distinct("fold").alias("n")).where("n > 1")
    assert crossing.count() == 0 and split.count() == 180
    result = ex.cross_validate(split, [0, 1], SETTINGS)
    # What remains: the split, twelve score tables, the fold table and the summary.
    assert len(set(os.listdir(folder)) - before) == 1 + 12 + 2
    folds = result.fold_results.collect()
    assert len(folds) == 12
    assert all(r["training_rows"] + r["validation_rows"] == 180 for r in folds)
    assert result.oof_scores.count() == 180 * 6 * 2
    assert result.oof_scores.where("score <= 0 OR score >= 1 OR isnan(score)").count() == 0
    summary = {r["candidate"]: r for r in result.summary.collect()}
    assert summary[result.best]["position"] == 1
    assert summary[result.best]["fold_roc_auc_mean"] > 0.95
    for r in summary.values():
        mine = [f["mean_column_roc_auc"] for f in folds if f["candidate"] == r["candidate"]]
        assert r["fold_roc_auc_mean"] == pytest.approx(np.mean(mine))
        assert r["fold_roc_auc_standard_deviation"] == pytest.approx(np.std(mine, ddof=1))
    macro = result.per_label.groupBy("candidate").agg(F.avg("f1").alias("f1")).collect()
    assert {r["candidate"]: round(r["f1"], 9) for r in macro} == {
        c: round(r["oof_macro_f1"], 9) for c, r in summary.items()
    }


def test_blend_and_submission(spark, corpus, tmp_path):
    settings = replace(SETTINGS, families=(ex.LOGISTIC, ex.SVM), representations=SETTINGS.representations[:1])
    split = ex.split_rows(corpus, 2, settings, meta_fraction=0.35)
    best = settings.candidates()[1]
    blend = ex.learn_blend(split, best, settings, draws=10)
    row = blend.audit.first()
    assert row["accepted"] == (row["blend_auc"] > row["best_single_auc"]) == blend.accepted
    test = spark.createDataFrame([(900, "word1 awful word2"), (901, "nothing known"), (902, "spam spam word3")], "id int, text string")
    template = spark.createDataFrame([(902, 0), (900, 1), (901, 2)], "id int, row_pos int")
    tables = ex.submission_tables(corpus, test, template, best, settings, blend.weights)
    assert set(tables) == {"best_single", "rank_blend"}
    paths = ex.write_submissions(tables, str(tmp_path / "out"), "id", ["x", "y"])
    back = spark.read.csv(paths["best_single"], header=True, inferSchema=True).collect()
    scores = {r["id"]: (r["x"], r["y"]) for r in back}
    assert scores[900][0] > scores[902][0] and scores[902][1] > scores[900][1]
    with pytest.raises(Exception, match="already exists"):
        ex.write_submissions(tables, str(tmp_path / "out"), "id", ["x", "y"])


def plain_scores(train, texts, char, loss, cost):
    """Scores of texts by a model of ``(text, outcome)`` pairs: dense features, Newton steps; no Spark."""

    def terms(text):
        text = text.lower()
        if char:
            return sorted({text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)})
        words = text.split()
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    seen = [terms(t) for t, _ in train]
    df = Counter(term for found in seen for term in set(found))
    index = {term: i for i, term in enumerate(sorted(t for t, n in df.items() if 2 <= n <= 0.995 * len(train)))}

    def row(found):
        out = np.zeros(len(index) + 1)
        for term, n in Counter(found).items():
            if term in index:
                out[index[term]] = 1.0 if char else (1 + np.log(n)) * (np.log((1 + len(train)) / (1 + df[term])) + 1)
        out /= np.linalg.norm(out) or 1.0
        out[-1] = 1.0
        return out

    x, y = np.array([row(f) for f in seen]), 2.0 * np.array([o for _, o in train]) - 1
    w = np.zeros(x.shape[1])
    for _ in range(60):
        _, slope = loss_and_slope(loss, x @ w, y)
        curved = cost * curvature(loss, x @ w, y)
        step = np.linalg.solve(np.eye(len(w)) + x.T @ (curved[:, None] * x), cost * x.T @ slope + w)
        w -= step * (0.5 if loss == SQUARED_HINGE else 1.0)
    margin = np.array([row(terms(t)) for t in texts]) @ w
    return 1 / (1 + np.exp(-margin)) if loss == LOGISTIC else 0.5 + np.arctan(margin) / np.pi


def test_scores_are_those_of_plain_fits(spark, corpus):
    """Every linear candidate, fitted and applied by the plan, gives the scores of the same model without Spark."""
    settings = replace(SETTINGS, families=(ex.LOGISTIC, ex.SVM), representations=ft.REPRESENTATIONS, tolerance=1e-7)
    train = [(r["text"], (r["x"], r["y"])) for r in corpus.where("id < 120").collect()]
    test = {r["id"]: r["text"] for r in corpus.where("id >= 120 AND id < 160").collect()}
    found = ex.fit_and_score(corpus.where("id < 120"), {"test": corpus.where("id >= 120 AND id < 160")}, settings)["test"]
    scores = {(r["candidate"], r["label"], r["id"]): r["score"] for r in found.collect()}
    assert len(scores) == 4 * 2 * len(test)
    for representation in settings.representations:
        for family, loss in ((ex.LOGISTIC, LOGISTIC), (ex.SVM, SQUARED_HINGE)):
            cost = settings.linear[representation.name, family].c
            for position, label in enumerate(settings.label_cols):
                wanted = plain_scores([(t, o[position]) for t, o in train], test.values(), representation.binary, loss, cost)
                got = [scores[ex.candidate_key(representation, family), label, i] for i in test]
                assert np.allclose(got, wanted, atol=2e-4), (representation.name, family, label)


def test_unknown_candidate(spark, corpus):
    with pytest.raises(ValueError, match="Unknown candidates"):
        ex.refit_and_score(corpus, corpus, ["nonsense"], SETTINGS)


@pytest.mark.parametrize("representation", ft.REPRESENTATIONS)
def test_terms_are_not_shuffled(spark, corpus, monkeypatch, representation):
    """A bounded vocabulary is looked up without a shuffle; beyond the bound the texts are shuffled once by id, never their terms."""
    counts = ft.term_counts(ft.with_terms(corpus, "text", representation), representation.binary)
    vocab = ft.with_idf(ft.vocabulary(counts, 180, 2, 0.9, 400), 180)
    make = ft.binary_ngrams if representation.binary else ft.tfidf

    def plan_and_rows(empty=False):
        df = (ft.transform_with if empty else make)(corpus, vocab, "id", "text", representation)
        rows = {(r["id"], r["term"]): (r["term_idx"], round(r["value"], 9)) for r in df.where("term IS NOT NULL").collect()}
        return df._jdf.queryExecution().executedPlan().toString(), rows, df.where("term IS NULL").count()

    plan, rows, bare = plan_and_rows()
    assert "Exchange" not in plan and bare == 0 and len(rows) > 1000
    monkeypatch.setattr(ft, "BROADCAST_ROWS", 100)
    plan, joined, _ = plan_and_rows()
    above, below = plan.split("Generate posexplode")
    assert "Exchange hashpartitioning(id" not in above and below.count("Exchange hashpartitioning(id") == 1
    assert joined == rows == plan_and_rows(empty=True)[1]


def test_vectors_are_packed_without_rows_of_python(spark, corpus):
    long = spark.createDataFrame([(1, 4, 0.5), (1, 0, 2.0), (2, None, None)], "id int, term_idx int, value double")
    packed = ft.to_vectors(long, "id", 10)
    assert "BatchEvalPython" not in packed._jdf.queryExecution().executedPlan().toString()
    rows = {r["id"]: r["features"] for r in packed.collect()}
    assert rows[1] == Vectors.sparse(10, {0: 2.0, 4: 0.5}) and rows[2] == Vectors.sparse(10, {})


def test_ties_at_the_end_of_a_vocabulary(spark, monkeypatch):
    """A thousand terms of one count and one long prefix: the first ones by name stay."""
    monkeypatch.setattr(profile, "SPLITTERS", 7)
    monkeypatch.setattr(profile, "FEW", 20)
    terms = [("same prefix " * 3 + f"{i * 7919 % 1000:04}", 5) for i in range(1000)] + [("rare", 1), ("often", 9)]
    table = spark.createDataFrame(terms, "term string, tf long").repartition(6)
    ordered = [t for t, _ in sorted(terms, key=lambda r: (-r[1], r[0]))]
    for limit in (1, 2, 3, 500, 1001, 1002, 5000):
        assert sorted(r["term"] for r in profile.most_frequent(table, "tf", "term", limit).collect()) == sorted(ordered[:limit])
    assert profile.most_frequent(table.where("false"), "tf", "term", 5).count() == 0
