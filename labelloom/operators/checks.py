"""Data-quality reports. Each returns a small DataFrame; ``require`` turns one into an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelloom.operators.ranking import seeded_hash

#: Digits of a hash by which rows are counted to find a cut-off.
PREFIX = 4


def require(report: DataFrame, violations: Sequence[str], message: str) -> None:
    """Raise when any of the violation counts of a one-row report is not zero."""
    row = report.select(*violations).first()
    found = {name: row[name] for name in violations if row[name]}
    if found:
        raise ValueError(f"{message}: {found}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a required column is absent. Extra columns are fine."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def check_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Rows, null ids, distinct ids as strings, and rows that share an id with another row."""
    require_columns(df, [id_col])
    per_id = df.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_ids"),
        F.count(F.when(known, 1)).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_id_rows"),
    )


def check_labels(df: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """Rows, and per label the count of values that are neither 0 nor 1 (nulls included)."""
    require_columns(df, label_cols)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count(F.when(~F.coalesce(F.col(c).isin(0, 1), F.lit(False)), 1)).alias(f"invalid_{c}")
            for c in label_cols
        ],
    )


def clean_text(df: DataFrame, text_col: str) -> DataFrame:
    """Null text becomes the empty string."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def text_report(df: DataFrame, text_col: str) -> DataFrame:
    """How many texts ``clean_text`` replaces."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(text_col).isNull(), 1)).alias("null_texts")
    )


def check_reconcile(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Row counts of two tables and the number of ids present in only one of them."""
    def tagged(df, is_left):
        return df.select(
            F.col(id_col).cast("string").alias("id"),
            F.lit(is_left).alias("l"),
            F.lit(1 - is_left).alias("r"),
        )

    per_id = tagged(left, 1).unionAll(tagged(right, 0)).groupBy("id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_id.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count(F.when(F.col("r") == 0, 1)).alias("only_left"),
        F.count(F.when(F.col("l") == 0, 1)).alias("only_right"),
    ).withColumn("row_difference", F.abs(F.col("left_rows") - F.col("right_rows")))


def sample_rows(
    df: DataFrame, n: int | None, seed: int, id_col: str, label_cols: Sequence[str], floor: int = 1000
) -> DataFrame:
    """``n`` rows without replacement in the order of a seeded hash, every label kept positive.

    A label's lowest-hashed positive row is in the sample exactly when the label has a positive
    row there, so adding that row for every label adds it only where it is missing.
    """
    if n is None:
        return df
    picked = df.withColumn("_pick", seeded_hash(seed, id_col))
    # Rows for each start of the hash, at most 16 ** PREFIX: they tell where the n-th row lies.
    starts = picked.groupBy(F.substring("_pick", 1, PREFIX).alias("start")).count().collect()
    if n < floor and n < sum(r["count"] for r in starts):
        raise ValueError(f"A sample below {floor} rows is too small for rare labels.")
    before, last = 0, None
    for start, count in sorted((r["start"], r["count"]) for r in starts):
        if before + count > n:
            edge = picked.where(F.substring("_pick", 1, PREFIX) == start).select(F.struct("_pick", F.col(id_col).alias("id")).alias("at"))
            last = edge.orderBy("at").limit(n - before).agg(F.max("at")).scalar() if n > before else None
            cut = start
            break
        before += count
    else:
        return df
    first_positive = picked.agg(
        *[F.min(F.when(F.col(c) == 1, F.col("_pick"))).alias(c) for c in label_cols]
    ).select(F.array_compact(F.array(*label_cols)).alias("picks"))
    taken = F.substring("_pick", 1, PREFIX) < cut
    if last is not None:
        taken = taken | (F.struct("_pick", F.col(id_col).alias("id")) <= last)
    return picked.where(taken | F.array_contains(first_positive.scalar(), F.col("_pick"))).drop("_pick")


def check_no_group_crosses(rows: DataFrame, group_col: str, part_col: str) -> DataFrame:
    """Groups, and groups whose rows lie in more than one part."""
    # min and max combine on the map side, so a hot group costs one row per task.
    per_group = rows.groupBy(group_col).agg(F.min(part_col).alias("low"), F.max(part_col).alias("high"))
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count(F.when(F.col("low") != F.col("high"), 1)).alias("crossing_groups"),
    )


def check_both_outcomes(rows: DataFrame, part_col: str, label_cols: Sequence[str]) -> DataFrame:
    """Per part and label: positives and negatives inside the part and in all other parts."""
    per_part = rows.groupBy(part_col).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in label_cols]
    )
    totals = per_part.agg(
        F.struct(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in label_cols])
    ).scalar()
    with_totals = per_part.withColumn("_all", totals)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.col(c).alias("positives"),
                (F.col("rows") - F.col(c)).alias("negatives"),
                (F.col("_all")[c] - F.col(c)).alias("other_positives"),
                (F.col("_all")["rows"] - F.col("_all")[c] - F.col("rows") + F.col(c)).alias("other_negatives"),
            )
            for c in label_cols
        ]
    )
    table = with_totals.select(part_col, F.inline(cells))
    counts = ("positives", "negatives", "other_positives", "other_negatives")
    return table.withColumn("has_both", reduce(lambda a, b: a & b, [F.col(c) > 0 for c in counts]))


def check_coverage(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    """Expected ids without a row, with several rows, and rows of ids that were not expected."""
    def tagged(df, is_expected):
        return df.select(
            F.col(id_col).alias("id"), F.lit(is_expected).alias("e"), F.lit(1 - is_expected).alias("a")
        )

    per_id = tagged(expected, 1).unionAll(tagged(actual, 0)).groupBy("id").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    return per_id.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("actual_rows"),
        F.count(F.when((F.col("e") > 0) & (F.col("a") == 0), 1)).alias("missing"),
        F.count(F.when((F.col("e") > 0) & (F.col("a") > 1), 1)).alias("repeated"),
        F.count(F.when((F.col("e") == 0), 1)).alias("unexpected"),
    )


def check_two_outcomes(df: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """Per label positives, negatives and whether both occur."""
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in label_cols])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.coalesce(F.col(c), F.lit(0)).alias("positives"),
                (F.col("rows") - F.coalesce(F.col(c), F.lit(0))).alias("negatives"),
            )
            for c in label_cols
        ]
    )
    return totals.select(F.inline(cells)).withColumn(
        "has_both", (F.col("positives") > 0) & (F.col("negatives") > 0)
    )
