"""Exact multilabel metrics on long score tables ``(id, <by>, label, score, truth)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.operators.ranking import counts_before, score_bucket


def attach_truth(scores: DataFrame, labelled: DataFrame, id_col: str, label_cols: Sequence[str]) -> DataFrame:
    """Add each row's true label to a long score table."""
    truth = labelled.select(id_col, *label_cols).unpivot([id_col], list(label_cols), "label", "truth")
    return scores.join(truth, [id_col, "label"])


def threshold_labels(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``prediction``: 1 where the score reaches the threshold."""
    return scored.withColumn("prediction", (F.col("score") >= F.lit(float(threshold))).cast("int"))


def confusion(predicted: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """tp, fp, fn and tn per key and label."""
    hit, yes = F.col("prediction") == 1, F.col("truth") == 1
    return predicted.groupBy(*by, "label").agg(
        F.count(F.when(hit & yes, 1)).alias("tp"),
        F.count(F.when(hit & ~yes, 1)).alias("fp"),
        F.count(F.when(~hit & yes, 1)).alias("fn"),
        F.count(F.when(~hit & ~yes, 1)).alias("tn"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` and 0 where undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _rates(tp, fp, fn) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def label_metrics(table: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 per label, from ``confusion``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = {"accuracy": ratio(tp + tn, tp + fp + fn + tn), **_rates(tp, fp, fn)}
    return table.select("*", *[value.alias(name) for name, value in rates.items()])


def element_accuracy(table: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Share of correct row-label cells, from ``confusion``."""
    right = F.sum(F.col("tp") + F.col("tn"))
    cells = F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return table.groupBy(*by).agg(ratio(right, cells).alias("element_wise_accuracy"))


def subset_accuracy(predicted: DataFrame, id_col: str, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Share of rows whose labels are all correct."""
    right = (F.col("prediction") == F.col("truth")).cast("int")
    per_row = predicted.groupBy(*by, id_col).agg(F.min(right).alias("all_right"))
    return per_row.groupBy(*by).agg(F.avg("all_right").alias("subset_accuracy"))


def macro_metrics(per_label: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Unweighted means over labels of precision, recall and F1."""
    return per_label.groupBy(*by).agg(
        *[F.avg(name).alias(f"macro_{name}") for name in ("precision", "recall", "f1")]
    )


def micro_metrics(table: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Precision, recall and F1 of the counts pooled over labels."""
    rates = _rates(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return table.groupBy(*by).agg(*[value.alias(f"micro_{name}") for name, value in rates.items()])


def roc_auc(scored: DataFrame, by: Sequence[str] = ("candidate", "label")) -> DataFrame:
    """Exact area under the ROC curve, ties at half; null when a key has one outcome.

    Rows first shrink to distinct scores. Pairs won inside a score bucket come from a window over
    that bucket; pairs won across buckets come from the bucket totals. No task sees a whole key.
    """
    by = list(by)
    distinct = (
        scored.groupBy(*by, "score")
        .agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
        .withColumn("_bucket", score_bucket("score"))
    )
    below = Window.partitionBy(*by, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    # Pair counts go beyond 64 bits on large tables; as doubles they stay exact to 2**53.
    won = F.col("pos").cast("double") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / F.lit(2.0))
    buckets = (
        distinct.withColumn("won", won)
        .groupBy(*by, "_bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return (
        counts_before(buckets, by, "_bucket", "neg", "_below")
        .groupBy(*by)
        .agg(
            F.try_divide(
                F.sum(F.col("won") + F.col("pos").cast("double") * F.col("_below")), pairs
            ).alias("roc_auc")
        )
    )


def mean_column_auc(auc: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Mean over labels of the defined areas."""
    return auc.groupBy(*by).agg(F.avg("roc_auc").alias("mean_column_roc_auc"))


def rank_auc_only(scored: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Per-label areas and their mean, for rank scores that have no threshold."""
    auc = roc_auc(scored, [*by, "label"])
    return auc.join(mean_column_auc(auc, by), list(by))


def all_metrics(
    scored: DataFrame, id_col: str, by: Sequence[str] = ("candidate",), threshold: float = 0.5
) -> DataFrame:
    """The nine aggregate metrics, one row per key."""
    by = list(by)
    predicted = threshold_labels(scored, threshold)
    table = confusion(predicted, by)
    per_label = label_metrics(table)
    return (
        element_accuracy(table, by)
        .join(subset_accuracy(predicted, id_col, by), by)
        .join(macro_metrics(per_label, by), by)
        .join(micro_metrics(table, by), by)
        .join(mean_column_auc(roc_auc(scored, [*by, "label"]), by), by)
    )


def per_label_table(scored: DataFrame, by: Sequence[str] = ("candidate",), threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and area per key and label."""
    by = [*by, "label"]
    table = label_metrics(confusion(threshold_labels(scored, threshold), by[:-1]))
    return table.drop("tp", "fp", "fn", "tn").join(roc_auc(scored, by), by)


def fold_summary(
    fold_metrics: DataFrame, oof_metrics: DataFrame, seconds: str | None = None
) -> DataFrame:
    """Per candidate what it is made of, the out-of-fold metrics, and mean and sample deviation of the fold areas."""
    made_of = [c for c in ("representation", "model_family", "model_input_adapter") if c in fold_metrics.columns]
    measures = [
        *[F.max(c).alias(c) for c in made_of],
        F.avg("mean_column_roc_auc").alias("fold_roc_auc_mean"),
        F.stddev_samp("mean_column_roc_auc").alias("fold_roc_auc_standard_deviation"),
    ]
    if seconds:
        measures.append(F.sum(seconds).alias("total_model_seconds"))
    renamed = oof_metrics.select(
        "candidate", *[F.col(c).alias(f"oof_{c}") for c in oof_metrics.columns if c != "candidate"]
    )
    joined = renamed.join(fold_metrics.groupBy("candidate").agg(*measures), "candidate")
    return joined.select("candidate", *made_of, *[c for c in joined.columns if c not in ("candidate", *made_of)])


def rank_candidates(summary: DataFrame) -> DataFrame:
    """Candidates from best to worst: fold mean, then out-of-fold area, then name."""
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.desc("fold_roc_auc_mean"), F.desc("oof_mean_column_roc_auc"), "candidate"
    )
    return summary.withColumn("position", F.row_number().over(order)).orderBy("position")


def auc_pivot(auc: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """Candidate by label grid of areas."""
    return auc.groupBy("candidate").pivot("label", list(label_cols)).agg(F.first("roc_auc"))
