"""Stratified folds and holdouts over whole duplicate groups.

All groups with the same label vector are interchangeable for stratification, so only the number
each part takes per label vector is decided; which groups those are follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from labelloom.operators.groups import label_signature
from labelloom.operators.ranking import hash_rank, seeded_hash, skew_safe_lookup, small_side


def _ranked(groups: DataFrame, label_cols: Sequence[str], seed: int) -> DataFrame:
    marked = groups.withColumn("_signature", label_signature(label_cols)).withColumn(
        "_pick", seeded_hash(seed, "group_id")
    )
    return hash_rank(marked, "_pick", "group_id", by=["_signature"], out="_rank")


def _signature_counts(groups: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    return groups.groupBy(label_signature(label_cols).alias("_signature")).agg(F.count(F.lit(1)).alias("_n"))


def fold_quotas(counts: dict[int, int], labels: int, k: int) -> dict[tuple[int, int], int]:
    """How many groups of each label vector every fold takes.

    Each fold gets the whole share; the fewer than ``k`` left over go, rarest label first, to the
    fold furthest below its even share of that label, then of all groups.
    """
    total = sum(counts.values())
    positives = [sum(n for s, n in counts.items() if s >> i & 1) for i in range(labels)]
    quota = {(s, f): n // k for s, n in counts.items() for f in range(k)}

    # Groups a fold holds so far, of all (None) and of each label.
    held = {(f, None): 0 for f in range(k)} | {(f, i): 0 for f in range(k) for i in range(labels)}

    def give(signature, fold, amount):
        held[fold, None] += amount
        for i in range(labels):
            if signature >> i & 1:
                held[fold, i] += amount

    for (signature, fold), amount in quota.items():
        give(signature, fold, amount)

    def rarest(signature):
        present = [i for i in range(labels) if signature >> i & 1]
        return min(present, key=lambda i: (positives[i], i)) if present else None

    def order(signature):
        label = rarest(signature)
        return (total + 1 if label is None else positives[label], signature)

    for signature in sorted(counts, key=order):
        label = rarest(signature)
        wanted = total if label is None else positives[label]
        open_folds = set(range(k))
        for _ in range(counts[signature] % k):
            fold = max(
                open_folds,
                key=lambda f: (wanted / k - held[f, label], total / k - held[f, None], -f),
            )
            quota[signature, fold] += 1
            give(signature, fold, 1)
            open_folds.discard(fold)
    return quota


def stratified_group_folds(
    groups: DataFrame, k: int, seed: int, label_cols: Sequence[str], method: str = "quota"
) -> DataFrame:
    """Add ``fold`` (0 to k-1) to a group table.

    ``quota`` balances every label across folds; its only driver step is the count per label
    vector, at most 2**labels rows. ``rotate`` deals the groups out in turn, carrying on from one
    label vector to the next, and needs no driver step.
    """
    ranked = _ranked(groups, label_cols, seed)
    counts = _signature_counts(groups, label_cols)
    if method == "rotate":
        earlier = Window.partitionBy(F.lit(0)).orderBy("_signature").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_signature", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        return (
            ranked.join(small_side(starts, 2 ** len(label_cols)), "_signature")
            .withColumn("fold", F.pmod(F.col("_rank") - 1 + F.col("_start"), F.lit(k)).cast("int"))
            .drop("_signature", "_pick", "_rank", "_start")
        )
    if method != "quota":
        raise ValueError(f"Unknown method: {method}")
    found = {row["_signature"]: row["_n"] for row in counts.collect()}
    quota = fold_quotas(found, len(label_cols), k)
    ranges = []
    for signature in found:
        start = 0
        for fold in range(k):
            taken = quota[signature, fold]
            if taken:
                ranges.append((signature, start + 1, start + taken, fold))
            start += taken
    table = groups.sparkSession.createDataFrame(
        ranges, "_signature bigint, _first bigint, _last bigint, fold int"
    )
    return (
        ranked.join(small_side(table, len(ranges)), "_signature")
        .where(F.col("_rank").between(F.col("_first"), F.col("_last")))
        .drop("_signature", "_pick", "_rank", "_first", "_last")
    )


def stratified_group_holdout(
    groups: DataFrame, fraction: float, seed: int, label_cols: Sequence[str], out: str = "held_out"
) -> DataFrame:
    """Add a boolean column that is true for ``fraction`` of the groups, label vector by label vector.

    Each label vector gives the whole part of its share; the groups still owed come one each from
    the label vectors with the largest fractional parts.
    """
    share = F.col("_n") * F.lit(fraction)
    by_remainder = Window.partitionBy(F.lit(0)).orderBy(F.desc(share - F.floor(share)), "_signature")
    everything = Window.partitionBy(F.lit(0))
    owed = F.round(F.sum("_n").over(everything) * F.lit(fraction)) - F.sum(F.floor(share)).over(everything)
    quotas = _signature_counts(groups, label_cols).select(
        "_signature",
        (F.floor(share) + F.when(F.row_number().over(by_remainder) <= owed, 1).otherwise(0)).alias("_quota"),
    )
    return (
        _ranked(groups, label_cols, seed)
        .join(small_side(quotas, 2 ** len(label_cols)), "_signature")
        .withColumn(out, F.col("_rank") <= F.col("_quota"))
        .drop("_signature", "_pick", "_rank", "_quota")
    )


def split_groups(
    groups: DataFrame,
    k: int,
    seed: int,
    label_cols: Sequence[str],
    meta_fraction: float | None = None,
    audit_fraction: float = 0.5,
) -> DataFrame:
    """Group table with ``partition`` (dev, meta_opt, meta_audit) and ``fold`` (null outside dev)."""
    if meta_fraction is None:
        return stratified_group_folds(groups, k, seed, label_cols).withColumn("partition", F.lit("dev"))
    held = stratified_group_holdout(groups, meta_fraction, seed + 101, label_cols, out="_meta")
    dev = held.where(~F.col("_meta")).drop("_meta")
    meta = held.where("_meta").drop("_meta")
    audited = stratified_group_holdout(meta, audit_fraction, seed + 202, label_cols, out="_audit")
    return (
        stratified_group_folds(dev, k, seed, label_cols)
        .withColumn("partition", F.lit("dev"))
        .unionByName(
            audited.withColumn("partition", F.when(F.col("_audit"), "meta_audit").otherwise("meta_opt"))
            .withColumn("fold", F.lit(None).cast("int"))
            .drop("_audit")
        )
    )


def assign_rows(keyed: DataFrame, groups: DataFrame, values: Sequence[str], id_col: str) -> DataFrame:
    """Carry group columns such as ``fold`` to the rows of each group."""
    return skew_safe_lookup(keyed, groups, ["group_key"], values, "group_size", id_col)


def rows_for_groups(keyed: DataFrame, selected: DataFrame, id_col: str) -> DataFrame:
    """Rows whose group is selected: a semi join that holds for groups of any size."""
    chosen = selected.select("group_key", "group_size").withColumn("_hit", F.lit(True))
    return (
        skew_safe_lookup(keyed, chosen, ["group_key"], ["_hit"], "group_size", id_col)
        .where("_hit")
        .drop("_hit")
    )
