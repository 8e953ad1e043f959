"""Class and row weights against label imbalance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelloom.operators.ranking import small_side


def class_weights(df: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """Balanced weights ``n / (2 * n_class)`` per label; null for a class that does not occur."""
    totals = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in label_cols])
    n = F.col("n").cast("double")
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.try_divide(n, 2.0 * F.col(c)).alias("positive_weight"),
                F.try_divide(n, 2.0 * (F.col("n") - F.col(c))).alias("negative_weight"),
            )
            for c in label_cols
        ]
    )
    return totals.select(F.inline(cells))


def row_weights(df: DataFrame, label_cols: Sequence[str], cap: float = 8.0, out: str = "row_weight") -> DataFrame:
    """Mean over labels of the balanced weight of the row's outcome, scaled to mean one, capped,
    scaled to mean one again. A label with one outcome is an error.

    The weight depends on the label vector alone, so its means come from the counts per vector.
    """
    labels = list(label_cols)
    totals = df.agg(
        F.struct(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).cast("double").alias(c) for c in labels])
    ).scalar()

    def balanced(c):
        t = F.col("_totals")
        share = F.when(F.col(c) == 1, t[c]).otherwise(t["n"] - t[c])
        one_outcome = (t[c] == 0) | (t[c] == t["n"])
        problem = F.raise_error(F.lit(f"Label {c} has one outcome.")).cast("double")
        return F.when(one_outcome, problem).otherwise(t["n"] / (2.0 * share))

    raw = reduce(lambda a, b: a + b, [balanced(c) for c in labels]) / float(len(labels))
    per_vector = (
        df.groupBy(*labels)
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
        .withColumn("_totals", totals)
        .select(*labels, "_n", raw.alias("_raw"))
    )
    mean = per_vector.agg(F.sum(F.col("_n") * F.col("_raw")) / F.sum("_n")).scalar()
    capped = per_vector.withColumn("_capped", F.least(F.col("_raw") / mean, F.lit(float(cap))))
    mean_capped = capped.agg(F.sum(F.col("_n") * F.col("_capped")) / F.sum("_n")).scalar()
    table = capped.select(*labels, (F.col("_capped") / mean_capped).alias(out))
    return df.join(small_side(table, 2 ** len(labels)), labels)
