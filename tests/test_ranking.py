"""Ranks and lookups against brute force, with one key holding most rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators.metrics import roc_auc
from labelloom.operators.ranking import average_ranks, hash_rank, seeded_hash, skew_safe_lookup


def test_hash_rank(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 9, 0).otherwise(1).alias("k"))
    ranked = hash_rank(df.withColumn("p", seeded_hash(7, "id")), "p", "id", by=["k"]).collect()
    for key in (0, 1):
        mine = sorted((r for r in ranked if r["k"] == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        hashes = [hashlib.md5(f"7|{r['id']}".encode()).hexdigest() for r in mine]
        assert hashes == sorted(hashes)


def test_scores_at_the_ends_of_the_scale(spark):
    scores = [0.0, -1.0, 5e-324, 1e-40, 1 - 2.0**-53, 1.0, 7.0, -1e308, 1e308, float("inf"), float("-inf"), 0.5, 0.0, 1e-300]
    df = spark.createDataFrame([(i, "a", s) for i, s in enumerate(scores)], "id int, k string, score double")
    found = {r["id"]: r["rank"] for r in average_ranks(df, ["k"], "score", "id").collect()}
    for i, s in enumerate(scores):
        assert found[i] == sum(x < s for x in scores) + (sum(x == s for x in scores) + 1) / 2
    truth = df.withColumn("truth", (F.col("id") >= 3).cast("int")).where("id IN (0, 3, 4)").withColumn("label", F.lit("l"))
    tiny = spark.createDataFrame([("c", "l", 0.0, 0), ("c", "l", 0.0, 0), ("c", "l", 1e-40, 1), ("c", "l", 0.3, 1)], "candidate string, label string, score double, truth int")
    assert roc_auc(tiny).first()["roc_auc"] == 1.0
    assert roc_auc(truth, ["k", "label"]).first()["roc_auc"] == 1.0


def test_nan_is_refused(spark):
    df = spark.createDataFrame([(1, "a", float("nan"), 1), (2, "a", 0.5, 0)], "id int, k string, score double, truth int")
    with pytest.raises(Exception, match="NaN in score"):
        roc_auc(df, ["k"]).collect()
    with pytest.raises(Exception, match="NaN in score"):
        average_ranks(df, ["k"], "score", "id").collect()


def test_average_ranks_with_ties_and_extremes(spark):
    random.seed(1)
    scores = [random.choice([0.0, 1.0, 0.5, 1e-15, 1 - 1e-15, -3.5, 7.25, random.random()]) for _ in range(2000)]
    df = spark.createDataFrame([(i, "a", s) for i, s in enumerate(scores)], "id int, k string, score double")
    found = {r["id"]: (r["rank"], r["n"]) for r in average_ranks(df, ["k"], "score", "id").collect()}
    for i, s in enumerate(scores):
        below, same = sum(x < s for x in scores), sum(x == s for x in scores)
        assert found[i] == (below + (same + 1) / 2, 2000)


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("k"))
    sizes = rows.groupBy("k").count().withColumn("v", F.col("k") * 2)
    found = skew_safe_lookup(rows, sizes, ["k"], ["v"], "count", "id")
    assert found.count() == 5000
    assert found.where("v IS NULL OR v <> k * 2").count() == 0


def test_lookup_keeps_rows_without_a_match(spark):
    rows = spark.range(10).withColumnRenamed("id", "k").withColumn("id", F.col("k"))
    some = spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "k bigint, v int, n bigint")
    found = {r["k"]: r["v"] for r in skew_safe_lookup(rows, some, ["k"], ["v"], "n", "id").collect()}
    assert found == {k: {1: 5, 2: 6}.get(k) for k in range(10)}
