"""Groups of rows whose texts are equal after canonicalisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.text import canonical_text
from labelloom.operators.ranking import skew_safe_lookup


def label_signature(label_cols: Sequence[str]) -> Column:
    """The labels of a row packed into one integer, the first label in the lowest bit."""
    bits = [F.shiftleft(F.col(c).cast("bigint"), i) for i, c in enumerate(label_cols)]
    return reduce(lambda a, b: a + b, bits)


def with_group_key(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``group_key``, the hash of the canonical text: equal exactly within a group.

    It identifies the group without any join, and keeps long texts out of the shuffles.
    """
    return df.withColumn("group_key", F.sha2(canonical_text(text_col), 256))


def group_table(keyed: DataFrame, id_col: str, label_cols: Sequence[str]) -> DataFrame:
    """One row per group: smallest id, size, labels combined by OR, signatures seen.

    Every aggregate combines before the shuffle, so a group holding a third of the rows is one
    row per task by then.
    """
    signature = label_signature(label_cols)
    return keyed.groupBy("group_key").agg(
        F.min(id_col).alias("group_id"),
        F.count(F.lit(1)).alias("group_size"),
        *[F.max(c).alias(c) for c in label_cols],
        (F.min(signature) != F.max(signature)).alias("inconsistent"),
    )


def duplicate_groups(keyed: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``group_id`` (smallest id of the group) and ``group_size``."""
    return skew_safe_lookup(keyed, groups, ["group_key"], ["group_id", "group_size"], "group_size", id_col)


def duplicate_report(groups: DataFrame) -> DataFrame:
    """Rows, groups, rows in groups of two or more, groups with unlike label vectors."""
    size = F.col("group_size")
    return groups.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.when(size > 1, size)), F.lit(0)).alias("rows_in_non_singleton_groups"),
        F.count(F.when(F.col("inconsistent"), 1)).alias("groups_with_inconsistent_labels"),
    )
