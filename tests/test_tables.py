"""Checks, duplicate groups, splits, weights and prediction tables on hand-made rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import checks, groups as gr, profile, splits, submit, weights as wt
from labelloom.plans import experiment as ex

LABELS = ["a", "b"]


def _report(df):
    return df.first().asDict()


def test_check_ids(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,), ("2",)], "id string")
    assert _report(checks.check_ids(df, "id")) == {"rows": 4, "null_ids": 1, "distinct_ids": 2, "repeated_id_rows": 2}
    with pytest.raises(ValueError, match="repeated_id_rows"):
        checks.require(checks.check_ids(df, "id"), ["null_ids", "repeated_id_rows"], "Bad ids")
    with pytest.raises(ValueError, match="Missing columns"):
        checks.check_ids(df, "key")


def test_check_labels(spark):
    df = spark.createDataFrame([(0, 1), (2, None), (None, 0)], "a int, b int")
    assert _report(checks.check_labels(df, LABELS)) == {"rows": 3, "invalid_a": 2, "invalid_b": 1}


def test_clean_text(spark):
    df = spark.createDataFrame([(None,), ("x",)], "text string")
    assert [r[0] for r in checks.clean_text(df, "text").collect()] == ["", "x"]
    assert _report(checks.text_report(df, "text")) == {"rows": 2, "null_texts": 1}


def test_check_reconcile(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([("2",), ("3",), ("4",), ("5",)], "id string")
    assert _report(checks.check_reconcile(left, right, "id")) == {
        "left_rows": 3, "right_rows": 4, "only_left": 1, "only_right": 2, "row_difference": 1,
    }


def test_sample_keeps_a_positive_row_of_every_label(spark):
    df = spark.range(500).select("id", (F.col("id") == 77).cast("int").alias("a"), (F.col("id") % 2).alias("b"))
    sampled = checks.sample_rows(df, 20, 3, "id", LABELS, floor=1)
    assert sampled.where("id = 77").count() == 1
    assert sampled.count() in (20, 21)
    assert sorted(r["id"] for r in sampled.collect()) == sorted(
        r["id"] for r in checks.sample_rows(df.repartition(5), 20, 3, "id", LABELS, floor=1).collect()
    )
    assert checks.sample_rows(df, 900, 3, "id", LABELS).count() == 500
    with pytest.raises(ValueError, match="too small"):
        checks.sample_rows(df, 20, 3, "id", LABELS)


@pytest.fixture(scope="module")
def duplicates(spark):
    rows = [
        (1, "Hello  World", 1, 0), (2, "hello world", 0, 0), (3, " HELLO\tworld ", 0, 1), (4, "Straße", 0, 0),
        (5, "STRASSE", 0, 0), (6, "ｆｕｌｌ", 1, 0), (7, "full", 1, 0), (8, "", 0, 0), (9, "  \n", 0, 0), (10, "alone", 1, 1),
    ]
    return gr.with_group_key(spark.createDataFrame(rows, "id int, text string, a int, b int"), "text")


def test_groups(duplicates):
    table = gr.group_table(duplicates, "id", LABELS)
    found = {r["group_id"]: (r["group_size"], r["a"], r["b"], r["inconsistent"]) for r in table.collect()}
    assert found == {
        1: (3, 1, 1, True), 4: (2, 0, 0, False), 6: (2, 1, 0, False), 8: (2, 0, 0, False), 10: (1, 1, 1, False),
    }
    assert _report(gr.duplicate_report(table)) == {
        "rows": 10, "groups": 5, "rows_in_non_singleton_groups": 9, "groups_with_inconsistent_labels": 1,
    }
    rows = {r["id"]: r["group_id"] for r in gr.duplicate_groups(duplicates, table, "id").collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10}


def test_rows_for_groups(duplicates):
    table = gr.group_table(duplicates, "id", LABELS)
    rows = splits.rows_for_groups(duplicates, table.where("b = 1"), "id")
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3, 10]


@pytest.fixture(scope="module")
def many_groups(spark):
    return spark.range(1000).select(
        F.col("id").alias("group_id"), F.sha2(F.col("id").cast("string"), 256).alias("group_key"),
        F.lit(1).cast("bigint").alias("group_size"), (F.col("id") % 11 == 0).cast("int").alias("a"),
        (F.col("id") % 7 == 0).cast("int").alias("b"),
    )


@pytest.mark.parametrize("method", ["quota", "rotate"])
def test_folds_are_balanced(many_groups, method):
    folds = splits.stratified_group_folds(many_groups, 3, 42, LABELS, method).collect()
    assert len({r["group_id"] for r in folds}) == len(folds) == 1000
    for chosen in (lambda r: True, lambda r: r["a"], lambda r: r["b"], lambda r: r["a"] and r["b"]):
        sizes = Counter(r["fold"] for r in folds if chosen(r))
        assert max(sizes.values()) - min(sizes.values()) <= 2


def test_fold_quotas_even_out_rare_labels():
    quota = splits.fold_quotas({0: 10, 1: 2, 3: 1, 2: 4}, 2, 3)
    for signature, n in {0: 10, 1: 2, 3: 1, 2: 4}.items():
        taken = [quota[signature, f] for f in range(3)]
        assert sum(taken) == n and max(taken) - min(taken) <= 1
    assert [quota[1, f] + quota[3, f] for f in range(3)] == [1, 1, 1]


def test_holdout_and_split(many_groups):
    held = splits.stratified_group_holdout(many_groups, 0.16, 5, LABELS).where("held_out")
    assert held.count() == 160
    assert abs(held.where("a = 1").count() - 0.16 * 91) < 2
    plan = splits.split_groups(many_groups, 3, 42, LABELS, meta_fraction=0.16)
    parts = Counter((r["partition"], r["fold"] is None) for r in plan.collect())
    assert parts == {("dev", False): 840, ("meta_opt", True): 80, ("meta_audit", True): 80}


def test_both_outcomes(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 0)], "fold int, a int")
    found = {r["fold"]: r["has_both"] for r in checks.check_both_outcomes(df, "fold", ["a"]).collect()}
    assert found == {0: False, 1: False}  # fold 1 lacks positives, so training without fold 0 does too


def test_coverage(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    actual = spark.createDataFrame([(2,), (2,), (3,), (9,)], "id int")
    assert _report(checks.check_coverage(expected, actual, "id")) == {
        "expected_rows": 3, "actual_rows": 4, "missing": 1, "repeated": 1, "unexpected": 1,
    }


def test_weights_refuse_one_outcome(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "id int, a int, b int")
    with pytest.raises(Exception, match="one outcome"):
        wt.row_weights(df, LABELS).collect()
    assert wt.class_weights(df, LABELS).where("label = 'a'").first()["positive_weight"] is None


def test_row_weights_have_mean_one(many_groups):
    weighted = wt.row_weights(many_groups, LABELS, cap=2.0)
    assert weighted.agg(F.avg("row_weight")).first()[0] == pytest.approx(1.0)


def test_top_words_ties_and_limit(spark):
    df = spark.createDataFrame([("kiwi apple", 1, 0), ("apple kiwi once", 0, 0), ("pear pear", 1, 1)], "text string, a int, b int")
    top = profile.top_words_by_class(df, "text", LABELS, k=2)
    found = {(r["class"], r["rank"]): (r["word"], r["frequency"]) for r in top.collect()}
    # "pear" and "once" are in one document only; ties go to the later word.
    assert found == {
        ("a", 1): ("kiwi", 1), ("a", 2): ("apple", 1), ("clean", 1): ("kiwi", 1), ("clean", 2): ("apple", 1),
    }


def test_most_frequent_breaks_ties_by_term(spark):
    terms = [(f"t{i:03d}", 5) for i in range(50)] + [("zz", 9), ("aa", 1)]
    df = spark.createDataFrame(terms, "term string, tf int")
    kept = [r["term"] for r in profile.most_frequent(df, "tf", "term", 20).orderBy("term").collect()]
    assert kept == sorted(["zz"] + [f"t{i:03d}" for i in range(19)])
    assert profile.most_frequent(df, "tf", "term", 500).count() == 52


def test_submission_checks(spark):
    template = spark.createDataFrame([("c", 0), ("a", 1), ("b", 2)], "id string, row_pos int")
    scores = spark.createDataFrame(
        [("a", "x", 0.5), ("a", "y", float("nan")), ("b", "x", 1.5), ("b", "y", 0.0)], "id string, label string, score double"
    )
    aligned = submit.align_to_template(scores, template, "id", ["x", "y"])
    assert [r["id"] for r in aligned.collect()] == ["c", "a", "b"]
    assert _report(submit.check_submission(aligned, template, "id", ["x", "y"])) == {
        "rows": 3, "missing_scores": 2, "non_finite_scores": 1, "out_of_range_scores": 1, "row_difference": 0,
    }


def test_prepare_tables_refuses_what_the_plan_cannot_use(spark):
    settings = ex.Settings("id", "text", ("a",))
    good = spark.createDataFrame([(1, None, 0), (2, "x", 1)], "id int, text string, a int")
    tables = ex.prepare_tables(good, settings, good.drop("a"), good.select("id"))
    assert [r["text"] for r in tables["labelled"].orderBy("id").collect()] == ["", "x"]
    bad_label = spark.createDataFrame([(1, "x", 2)], "id int, text string, a int")
    for rows, message in (
        (good.unionAll(good), "Unusable ids"),
        (bad_label, "Labels other than 0 and 1"),
        (spark.createDataFrame([(None, "x", 1)], "id int, text string, a int"), "Unusable ids"),
    ):
        with pytest.raises(ValueError, match=message):
            ex.prepare_tables(rows, settings)
        with pytest.raises(ValueError, match=message):
            ex.split_rows(rows, 2, settings)
    with pytest.raises(ValueError, match="template"):
        ex.prepare_tables(good, settings, good, good.where("id = 1").select("id"))
