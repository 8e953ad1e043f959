"""Ranks and lookups that hold when one key owns a large share of the rows.

A window with few partition keys would sort most of the table in one task. Here each key's rows
are first cut into buckets that follow the sort order; rows are numbered inside a bucket, and
the small table of bucket counts supplies what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.staging import stage

SPREAD = 256
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast where the side's largest possible number of rows is small; else leave the
    join to the optimizer."""
    return F.broadcast(df) if most_rows <= BROADCAST_ROWS else df


def seeded_hash(seed: int, col: str) -> Column:
    """A reproducible uniform order of ids: md5 of ``seed|id``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))


def counts_before(counts: DataFrame, by: Sequence[str], bucket: str, amount: str, out: str) -> DataFrame:
    """Running total of ``amount`` over the earlier buckets of each key (a small table)."""
    window = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0)))


def hash_rank(
    df: DataFrame, pick: str, tie: str, by: Sequence[str] = (), out: str = "rank", digits: int = 3
) -> DataFrame:
    """``row_number() over (partition by by order by pick, tie)`` for a hexadecimal hash ``pick``.

    The first hex digits are the bucket: hashes are uniform, so 16**digits buckets share any key's
    rows evenly, and their order is the order of the hash.
    """
    by = list(by)
    bucketed = df.withColumn("_bucket", F.substring(pick, 1, digits))
    offsets = counts_before(
        bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")), by, "_bucket", "_n", "_before"
    ).drop("_n")
    inside = Window.partitionBy(*by, "_bucket").orderBy(pick, tie)
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*by, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_inside", "_before")
    )


def skew_safe_lookup(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], values: Sequence[str], size: str, row_id: str
) -> DataFrame:
    """Left join of rows to one lookup row per key, where ``size`` is the key's number of rows.

    The lookup is written once, since it is read three times. Keys with more than a thousandth of all rows number fewer than a thousand, so they are
    broadcast; their rows then enter the shuffle spread over SPREAD values instead of on one key.
    """
    keys, values = list(keys), list(values)
    lookup = stage(lookup.select(*keys, *values, *([] if size in [*keys, *values] else [size])), "lookup")
    total = lookup.agg(F.sum(size)).scalar()
    heavy = lookup.where(F.col(size) * 1000 > total).select(
        *keys, *[F.col(v).alias(f"_heavy_{v}") for v in values], F.lit(True).alias("_is_heavy")
    )
    light = lookup.where(F.col(size) * 1000 <= total).select(*keys, *values, F.lit(0).alias("_spread"))
    spread = F.when(F.col("_is_heavy"), F.pmod(F.xxhash64(row_id), F.lit(SPREAD)) + 1).otherwise(0)
    return (
        rows.join(F.broadcast(heavy), keys, "left")
        .withColumn("_spread", spread.cast("int"))
        .join(light, [*keys, "_spread"], "left")
        .select(
            *[F.col(c) for c in rows.columns],
            *[F.coalesce(F.col(f"_heavy_{v}"), F.col(v)).alias(v) for v in values],
        )
    )


#: Beyond the log odds of every double between 0 and 1, at 64 steps a unit (the least is -744.4).
ENDS = 60_000


def score_bucket(score: str) -> Column:
    """A bucket that never decreases with the score and is fine where scores crowd; NaN is an error.

    Probabilities gather near 0 and 1, so buckets are even steps of the log odds; anything
    outside (0, 1) falls on even steps of a logarithm beyond either end.
    """
    s = F.col(score)
    inside = F.floor(F.log(s / (1 - s)) * 64)

    def beyond(distance: Column) -> Column:
        return F.floor(F.least(F.log1p(distance) * 64, F.lit(float(ENDS))))

    return (
        F.when(F.isnan(s), F.raise_error(F.lit(f"NaN in {score}")).cast("bigint"))
        .when(s <= 0, -ENDS - beyond(-s))
        .when(s >= 1, ENDS + beyond(s - 1))
        .otherwise(inside)
        .cast("int")
    )


def average_ranks(scores: DataFrame, by: Sequence[str], score: str, row_id: str, out: str = "rank") -> DataFrame:
    """Average rank of each row's score within its key, ties sharing the mean rank; also ``n``."""
    by = list(by)
    distinct = (
        scores.groupBy(*by, score)
        .agg(F.count(F.lit(1)).alias("_ties"))
        .withColumn("_bucket", score_bucket(score))
    )
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    )
    per_bucket = distinct.groupBy(*by, "_bucket").agg(F.sum("_ties").alias("_n"))
    whole = Window.partitionBy(*by)
    offsets = counts_before(per_bucket, by, "_bucket", "_n", "_before").withColumn(
        "n", F.sum("_n").over(whole)
    ).drop("_n")
    ranked = (
        distinct.withColumn("_inside", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
        .join(offsets, [*by, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_inside") + (F.col("_ties") + 1) / F.lit(2.0))
    )
    return skew_safe_lookup(scores, ranked, [*by, score], [out, "n"], "_ties", row_id)
