"""Rank blending: learn non-negative weights on one partition, audit them on another."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelloom.operators.metrics import roc_auc
from labelloom.operators.ranking import average_ranks
from labelloom.operators.scoring import clip_scores
from labelloom.staging import stage

#: Cells of the first grid of scores, how many times finer each further grid is, and how many grids there are.
GRID, FINER, GRIDS = 2048, 32, 3
#: Pool rows of a label that one job measures exactly.
MEASURED = 8


def fractional_ranks(scores: DataFrame, id_col: str) -> DataFrame:
    """Average rank over (n + 1), per candidate and label within the batch, as ``fraction``."""
    return (
        average_ranks(scores, ["candidate", "label"], "score", id_col)
        .withColumn("fraction", F.col("rank") / (F.col("n") + 1.0))
        .drop("rank", "n")
    )


def wide_ranks(ranks: DataFrame, id_col: str, candidates: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per id and label with a column per candidate, ``r0``, ``r1``, ..."""
    return ranks.groupBy(id_col, "label").agg(
        *[F.max(F.when(F.col("candidate") == c, F.col("fraction"))).alias(f"r{i}") for i, c in enumerate(candidates)],
        *[F.max(c).alias(c) for c in keep],
    )


#: The shares of the first of two candidates, and the concentration of the draws.
SHARES, CONCENTRATION = (0.25, 0.5, 0.75), 0.7


def weight_pool(n: int, draws: int = 384, seed: int = 345) -> list[list[float]]:
    """Candidate weight vectors: equal, each alone, each pair at three shares, Dirichlet draws."""
    alone, share = np.eye(n), np.array(SHARES)[None, :, None]
    first, second = np.triu_indices(n, 1)
    pairs = alone[first, None] * share + alone[second, None] * (1 - share)
    drawn = np.random.default_rng(seed).dirichlet([CONCENTRATION] * n, size=draws)
    return np.concatenate([np.full((1, n), 1 / n), alone, pairs.reshape(-1, n), drawn]).tolist()


def pool_table(spark: SparkSession, pool: Sequence[Sequence[float]]) -> DataFrame:
    """The pool as a table with columns ``pool_id``, ``w0``, ``w1``, ..."""
    n = len(pool[0])
    schema = "pool_id int, " + ", ".join(f"w{i} double" for i in range(n))
    return spark.createDataFrame([(p, *row) for p, row in enumerate(pool)], schema)


def _blended(n: int):
    return reduce(lambda a, b: a + b, [F.col(f"r{i}") * F.col(f"w{i}") for i in range(n)])


def search_weights(
    ranks: DataFrame, id_col: str, candidates: Sequence[str], pool: DataFrame, mode: str = "global"
) -> DataFrame:
    """The pool row with the best area: one for all labels, or one per label. First wins ties.

    Every row meets every pool row, so nothing per row may be shuffled for all of them. A first
    pass counts positives and negatives on a grid of blended scores, combined on the map side;
    that bounds each area from both sides. Pool rows whose upper bound reaches the best lower bound stay
    open; while these are more than ``MEASURED`` and become fewer, they alone are bounded again on a finer grid. The rows
    still open are measured exactly, ``MEASURED`` of a label at a time, so the result is that of measuring them all and a
    job shuffles no more than that many scores per row, however alike the pool rows are.
    """
    if mode not in ("global", "per-label"):
        raise ValueError(f"Unknown mode: {mode}")
    n = len(candidates)
    goal = ["label"] if mode == "per-label" else []
    # All passes read the ranks, so they are written once.
    wide = stage(wide_ranks(ranks, id_col, candidates, keep=["truth"]), "wide_ranks")
    found, grid = _open_rows(_met(wide, pool, None, goal, n), goal, GRID), GRID
    still = found.collect()  # at most a row per pool row and label, as below
    for _ in range(GRIDS - 1):
        if not _crowded(still, goal):
            break
        grid *= FINER
        chosen = wide.sparkSession.createDataFrame(still, found.schema)
        before, still = len(still), _open_rows(_met(wide, pool, chosen, goal, n), goal, grid).collect()
        if len(still) == before:
            break
    areas = []
    for rows in _batches(still, goal):
        chosen = wide.sparkSession.createDataFrame(rows, found.schema)
        auc = roc_auc(_met(wide, pool, chosen, goal, n), ["pool_id", "label"])
        areas.append(auc.groupBy("pool_id", *goal).agg(F.avg("roc_auc").alias("roc_auc")))
    if len(areas) > 1:
        areas = [stage(one, "areas") for one in areas]
    order = Window.partitionBy(*(goal or [F.lit(0)])).orderBy(F.desc("roc_auc"), "pool_id")
    return (
        reduce(DataFrame.unionByName, areas).withColumn("_order", F.row_number().over(order))
        .where(F.col("_order") == 1)
        .drop("_order")
        .join(pool, "pool_id")
        .select(*goal, "pool_id", *[f"w{i}" for i in range(n)], "roc_auc")
    )


def _met(wide: DataFrame, pool: DataFrame, chosen: DataFrame | None, goal: list[str], n: int) -> DataFrame:
    """``label, truth, pool_id, score`` of every row and every chosen pool row, which are all of them without a choice."""
    entry = F.struct("pool_id", *[f"w{i}" for i in range(n)])
    if chosen is not None and goal:
        lists = chosen.join(pool, "pool_id").groupBy("label").agg(F.collect_list(entry).alias("pool"))
        met = wide.join(F.broadcast(lists), "label").select("*", F.inline("pool")).drop("pool")
    else:
        rows = pool if chosen is None else chosen.join(pool, "pool_id")
        met = wide.select("*", F.inline(rows.agg(F.collect_list(entry)).scalar()))
    return met.select("label", "truth", "pool_id", _blended(n).alias("score"))


def _open_rows(scores: DataFrame, goal: list[str], grid: int) -> DataFrame:
    """Pool rows, per label if that is the goal, that can still have the best area as far as a grid of scores tells."""
    cells = scores.groupBy("pool_id", "label", F.floor(F.col("score") * grid).alias("cell")).agg(
        F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg")
    )
    below = Window.partitionBy("pool_id", "label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    pos, pairs = F.col("pos").cast("double"), F.sum("pos").cast("double") * F.sum("neg")
    sure = pos * F.coalesce(F.sum("neg").over(below), F.lit(0))
    bounds = (
        cells.select("pool_id", "label", "pos", "neg", sure.alias("sure"))
        .groupBy("pool_id", "label")
        .agg(
            F.try_divide(F.sum("sure"), pairs).alias("low"),
            F.try_divide(F.sum(F.col("sure") + pos * F.col("neg")), pairs).alias("high"),
        )
        .groupBy("pool_id", *goal)
        .agg(F.avg("low").alias("low"), F.avg("high").alias("high"))
    )
    best_low = F.max("low").over(Window.partitionBy(*(goal or [F.lit(0)])))
    # Bounds are means of quotients; the margin is far above their rounding error.
    return bounds.withColumn("best", best_low).where(F.col("high") >= F.col("best") - 1e-9).select("pool_id", *goal)


def _numbered(rows: Sequence, goal: list[str]) -> list[tuple[int, tuple]]:
    """Pool rows with their place among those of the same label."""
    places: Counter = Counter()
    numbered = []
    for row in sorted(rows, key=lambda r: r["pool_id"]):
        label = row["label"] if goal else None
        numbered.append((places[label], row))
        places[label] += 1
    return numbered


def _crowded(rows: Sequence, goal: list[str]) -> bool:
    return any(place >= MEASURED for place, _ in _numbered(rows, goal))


def _batches(rows: Sequence, goal: list[str]) -> list[list]:
    """The pool rows in parts of at most ``MEASURED`` of each label; one empty part if there are none."""
    numbered = _numbered(rows, goal)
    last = max((place for place, _ in numbered), default=0)
    return [[row for place, row in numbered if place // MEASURED == b] for b in range(last // MEASURED + 1)]


def blend_weights_table(found: DataFrame, candidates: Sequence[str], label_cols: Sequence[str]) -> DataFrame:
    """Long ``(label, candidate, weight)``; weights found for all labels are given to each."""
    if "label" not in found.columns:
        found = found.withColumn("label", F.explode(F.array(*[F.lit(c) for c in label_cols])))
    cells = F.array(
        *[F.struct(F.lit(c).alias("candidate"), F.col(f"w{i}").alias("weight")) for i, c in enumerate(candidates)]
    )
    return found.select("label", F.inline(cells))


def check_weights(weights: DataFrame) -> DataFrame:
    """Labels whose weights do not sum to one."""
    sums = weights.groupBy("label").agg(F.sum("weight").alias("total"))
    return sums.agg(
        F.count(F.lit(1)).alias("labels"),
        F.count(F.when(F.abs(F.col("total") - 1) > 1e-8, 1)).alias("labels_off_one"),
    )


def apply_weights(scores: DataFrame, weights: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Blend the fractional ranks of one complete batch, clipped inside (0, 1).

    Ranks depend on the whole batch: apply to all rows at once, never to a part of them. The
    weights have one row per label and candidate.
    """
    blended = (
        fractional_ranks(scores, id_col)
        .join(weights, ["label", "candidate"])
        .groupBy(id_col, "label")
        .agg(F.sum(F.col("fraction") * F.col("weight")).alias("score"), *[F.max(c).alias(c) for c in keep])
    )
    return clip_scores(blended)


def audit_blend(blend_auc: DataFrame, single_auc: DataFrame) -> DataFrame:
    """Accept the blend only if its mean area is strictly above the best single candidate's."""
    return blend_auc.agg(F.max("mean_column_roc_auc").alias("blend_auc")).select(
        "blend_auc", single_auc.agg(F.max("mean_column_roc_auc")).scalar().alias("best_single_auc")
    ).withColumn("accepted", F.col("blend_auc") > F.col("best_single_auc"))


#: Columns of the best single candidate's metrics that a blend of ranks has none of.
THRESHOLDED = (
    "element_wise_accuracy", "subset_accuracy", "macro_precision", "macro_recall", "macro_f1",
    "micro_precision", "micro_recall", "micro_f1",
)
BLEND = "rank_blend"


def blend_results(audit: DataFrame, optimisation_auc: float, single_metrics: DataFrame) -> DataFrame:
    """Three rows: the blend where it was learned, the blend on the audit part, and the best single candidate there.

    ``audit`` is the row of ``audit_blend``, ``single_metrics`` that of ``all_metrics``; ranks have no threshold, so the
    blend has only an area. Exactly one of the two audit rows is accepted.
    """
    none = [F.lit(None).cast("double").alias(c) for c in THRESHOLDED]
    learned = audit.select(
        F.lit("optimisation").alias("partition"), F.lit(BLEND).alias("candidate"), F.lit(float(optimisation_auc)).alias("mean_column_roc_auc"),
        F.lit(None).cast("string").alias("metric_scope"), F.lit(None).cast("boolean").alias("accepted"), *none,
    )
    audited = audit.select(
        F.lit("audit").alias("partition"), F.lit(BLEND).alias("candidate"), F.col("blend_auc").alias("mean_column_roc_auc"),
        F.lit("roc_auc").alias("metric_scope"), "accepted", *none,
    )
    single = single_metrics.select(
        F.lit("audit").alias("partition"), "candidate", "mean_column_roc_auc", F.lit("all").alias("metric_scope"),
        audit.select(~F.col("accepted")).scalar().alias("accepted"), *THRESHOLDED,
    )
    return learned.unionByName(audited).unionByName(single)


def audit_per_label(blended: DataFrame) -> DataFrame:
    """The blend's area for every label of the audit part."""
    return roc_auc(blended, ["label"]).select(F.lit(BLEND).alias("candidate"), "label", "roc_auc")
