"""Metrics, rank blending and prediction tables on stand-in scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import blend as bl, metrics as mt, scoring, submit
from labelloom.operators.splits import assign_rows, stratified_group_holdout
from queries.common import (
    CANDIDATES,
    CORPUS_SQL,
    FOLDED_CORPUS_SQL,
    GROUPS_SQL,
    LABELS,
    SEED,
    bigints,
    corpus,
    folded_corpus,
    groups,
    keyed_corpus,
    rounded,
    scores_sql,
    stand_in_scores,
    unlabelled,
)
from queries.feature_queries import UNLABELLED_SQL
from queries.table_queries import holdout_sql


EXTREMES = (1e-40, 0.0, -1.0, 5e-324, 1 - 2.0**-53, 1.0, 7.0, 0.3)


def _scored(spark, sf):
    return stand_in_scores(corpus(spark, sf))


def _predicted(spark, sf):
    return mt.threshold_labels(_scored(spark, sf))


def _confusion(spark, sf):
    return mt.confusion(_predicted(spark, sf))


def attach_truth(spark, sf):
    scores = _scored(spark, sf).drop("truth")
    return bigints(rounded(mt.attach_truth(scores, corpus(spark, sf), "doc_id", LABELS), "score"), "truth")


def threshold_labels(spark, sf):
    return bigints(_predicted(spark, sf).select("doc_id", "candidate", "label", "prediction"), "prediction")


def confusion(spark, sf):
    return _confusion(spark, sf)


def label_metrics(spark, sf):
    return rounded(mt.label_metrics(_confusion(spark, sf)), "accuracy", "precision", "recall", "f1")


def element_accuracy(spark, sf):
    return rounded(mt.element_accuracy(_confusion(spark, sf)), "element_wise_accuracy")


def subset_accuracy(spark, sf):
    return rounded(mt.subset_accuracy(_predicted(spark, sf), "doc_id"), "subset_accuracy")


def macro_metrics(spark, sf):
    table = mt.macro_metrics(mt.label_metrics(_confusion(spark, sf)))
    return rounded(table, "macro_precision", "macro_recall", "macro_f1")


def micro_metrics(spark, sf):
    return rounded(mt.micro_metrics(_confusion(spark, sf)), "micro_precision", "micro_recall", "micro_f1")


def roc_auc(spark, sf):
    return rounded(mt.roc_auc(_scored(spark, sf)), "roc_auc")


def mean_column_auc(spark, sf):
    return rounded(mt.mean_column_auc(mt.roc_auc(_scored(spark, sf))), "mean_column_roc_auc")


def rank_auc_only(spark, sf):
    return rounded(mt.rank_auc_only(_scored(spark, sf)), "roc_auc", "mean_column_roc_auc")


def per_label_table(spark, sf):
    return rounded(mt.per_label_table(_scored(spark, sf)), "accuracy", "precision", "recall", "f1", "roc_auc")


def all_metrics(spark, sf):
    table = mt.all_metrics(_scored(spark, sf), "doc_id")
    return rounded(table, *[c for c in table.columns if c != "candidate"])


def _summary(spark, sf):
    scored = stand_in_scores(folded_corpus(spark, sf))
    by_fold = mt.mean_column_auc(mt.roc_auc(scored, ["fold", "candidate", "label"]), ["fold", "candidate"])
    return mt.fold_summary(by_fold, mt.mean_column_auc(mt.roc_auc(scored)))


def fold_summary(spark, sf):
    table = _summary(spark, sf)
    return rounded(table, *[c for c in table.columns if c != "candidate"])


def rank_candidates(spark, sf):
    return bigints(mt.rank_candidates(_summary(spark, sf)).select("position", "candidate"), "position")


def auc_pivot(spark, sf):
    return rounded(mt.auc_pivot(mt.roc_auc(_scored(spark, sf)), LABELS), *LABELS)


def fractional_ranks(spark, sf):
    ranks = bl.fractional_ranks(_scored(spark, sf), "doc_id")
    return rounded(ranks.select("doc_id", "candidate", "label", "fraction"), "fraction")


def _extreme(spark, sf):
    """Scores at both ends of the scale: tiny, zero, negative, one and above, next to ordinary ones."""
    values = F.array(*[F.lit(v) for v in EXTREMES])
    score = F.element_at(values, (F.col("n_chars") % len(EXTREMES) + 1).cast("int")) * (1 + F.col("n_chars") % 3)
    return _scored(spark, sf).where("candidate = 'spread'").drop("score").join(
        corpus(spark, sf).select("doc_id", score.alias("score")), "doc_id"
    )


def roc_auc_extreme_scores(spark, sf):
    return rounded(mt.roc_auc(_extreme(spark, sf)), "roc_auc")


def fractional_ranks_extreme_scores(spark, sf):
    ranks = bl.fractional_ranks(_extreme(spark, sf), "doc_id")
    return rounded(ranks.select("doc_id", "label", "fraction"), "fraction")


def _halves(spark, sf):
    """Stand-in scores of the two halves of the corpus, whole groups in one half."""
    halves = stratified_group_holdout(groups(spark, sf), 0.5, SEED + 202, LABELS)
    rows = assign_rows(keyed_corpus(spark, sf), halves, ["held_out"], "doc_id")
    return stand_in_scores(rows.where("NOT held_out")), stand_in_scores(rows.where("held_out"))


def _found(spark, sf, mode):
    optimisation, _ = _halves(spark, sf)
    ranks = bl.fractional_ranks(optimisation, "doc_id")
    pool = bl.pool_table(spark, bl.weight_pool(len(CANDIDATES), draws=0))
    return bl.search_weights(ranks, "doc_id", CANDIDATES, pool, mode)


def search_weights(spark, sf):
    return bigints(rounded(_found(spark, sf, "global"), "w0", "w1", "w2", "roc_auc"), "pool_id")


def search_weights_per_label(spark, sf):
    return bigints(rounded(_found(spark, sf, "per-label"), "w0", "w1", "w2", "roc_auc"), "pool_id")


DRAWN = bl.weight_pool(len(CANDIDATES), draws=384, seed=SEED + 303)


def search_weights_drawn(spark, sf):
    """The search over the whole pool, Dirichlet draws included."""
    optimisation, _ = _halves(spark, sf)
    ranks = bl.fractional_ranks(optimisation, "doc_id")
    found = bl.search_weights(ranks, "doc_id", CANDIDATES, bl.pool_table(spark, DRAWN))
    return bigints(rounded(found, "w0", "w1", "w2", "roc_auc"), "pool_id")


def blend_weights_table(spark, sf):
    table = bl.blend_weights_table(_found(spark, sf, "per-label"), CANDIDATES, LABELS)
    return rounded(table, "weight")


def check_weights(spark, sf):
    return bl.check_weights(bl.blend_weights_table(_found(spark, sf, "global"), CANDIDATES, LABELS))


def _weights(spark):
    rows = [(label, c, w) for label in LABELS for c, w in zip(CANDIDATES, (0.5, 0.3, 0.2))]
    return spark.createDataFrame(rows, "label string, candidate string, weight double")


def apply_weights(spark, sf):
    return rounded(bl.apply_weights(_scored(spark, sf), _weights(spark), "doc_id"), "score")


def _audited(spark, sf):
    """The search's result, the blend of the audit half, and the scores of that half."""
    _, audit = _halves(spark, sf)
    found = _found(spark, sf, "global")
    weights = bl.blend_weights_table(found, CANDIDATES, LABELS)
    return found, bl.apply_weights(audit, weights, "doc_id", keep=["truth"]), audit


def _audit_report(blended, audit):
    single = mt.mean_column_auc(mt.roc_auc(audit.where("candidate = 'spread'")))
    return bl.audit_blend(mt.mean_column_auc(mt.roc_auc(blended.withColumn("candidate", F.lit("blend")))), single)


def audit_blend(spark, sf):
    _, blended, audit = _audited(spark, sf)
    return rounded(_audit_report(blended, audit), "blend_auc", "best_single_auc")


def blend_results(spark, sf):
    found, blended, audit = _audited(spark, sf)
    single = mt.all_metrics(audit.where("candidate = 'spread'"), "doc_id")
    table = bl.blend_results(_audit_report(blended, audit), found.first()["roc_auc"], single)
    return rounded(table, "mean_column_roc_auc", *bl.THRESHOLDED)


def blend_audit_per_label(spark, sf):
    return rounded(bl.audit_per_label(_audited(spark, sf)[1]), "roc_auc")


def clip_scores(spark, sf):
    clipped = scoring.clip_scores(_scored(spark, sf))
    at_ends = clipped.select(
        "doc_id", "candidate", "label", (F.col("score") > 0).alias("above_zero"), (F.col("score") < 1).alias("below_one"),
        "score",
    )
    return rounded(at_ends, "score")


def score_margin(spark, sf):
    margins = corpus(spark, sf).select("doc_id", ((F.col("n_chars") % 2001) / 100.0 - 10.0).alias("margin"))
    return rounded(
        margins.select(
            "doc_id",
            scoring.bounded_margin("margin").alias("score"),
            scoring.probability("margin").alias("probability"),
        ),
        "score",
        "probability",
    )


def _template(spark, sf):
    # Descending ids, so that the order is not that of the scores.
    return unlabelled(spark, sf).select("doc_id", (-F.col("doc_id")).alias("row_pos"))


def _test_scores(spark, sf):
    rows = unlabelled(spark, sf).withColumns({c: F.lit(0) for c in LABELS})
    return stand_in_scores(rows).where("candidate = 'spread'").withColumn(
        "score", F.when(F.col("label") == "toxic", F.col("score")).otherwise(1 - F.col("score"))
    )


def align_to_template(spark, sf):
    aligned = submit.align_to_template(_test_scores(spark, sf), _template(spark, sf), "doc_id", LABELS)
    return rounded(aligned, *LABELS)


def check_submission(spark, sf):
    """Scores of only the documents with an even length, so that some are missing."""
    partial = _test_scores(spark, sf).join(
        unlabelled(spark, sf).where("n_chars % 2 = 0").select("doc_id"), "doc_id", "left_semi"
    )
    template = _template(spark, sf)
    return submit.check_submission(
        submit.align_to_template(partial, template, "doc_id", LABELS), template, "doc_id", LABELS
    )


QUERIES = {
    f.__name__: f
    for f in (
        attach_truth, threshold_labels, confusion, label_metrics, element_accuracy, subset_accuracy,
        macro_metrics, micro_metrics, roc_auc, mean_column_auc, rank_auc_only, per_label_table,
        all_metrics, fold_summary, rank_candidates, auc_pivot, fractional_ranks,
        roc_auc_extreme_scores, fractional_ranks_extreme_scores, search_weights,
        search_weights_per_label, search_weights_drawn, blend_weights_table, check_weights,
        apply_weights, audit_blend, blend_results, blend_audit_per_label, clip_scores, score_margin, align_to_template, check_submission,
    )
}

SCORED_SQL = CORPUS_SQL + ", " + scores_sql("corpus")
CONFUSION_SQL = SCORED_SQL + """, confused AS (
  SELECT candidate, label,
    count(*) FILTER (WHERE score >= 0.5 AND truth = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND truth = 0) AS fp,
    count(*) FILTER (WHERE score < 0.5 AND truth = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND truth = 0) AS tn
  FROM scored GROUP BY ALL)"""


def _ratio(a, b):
    return f"CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


LABEL_METRICS_SQL = CONFUSION_SQL + f""", measured AS (
  SELECT *, {_ratio("tp + tn", "(tp + fp + fn + tn)")} AS accuracy, {_ratio("tp", "(tp + fp)")} AS precision,
    {_ratio("tp", "(tp + fn)")} AS recall, {_ratio("2 * tp", "(2 * tp + fp + fn)")} AS f1 FROM confused)"""


def _auc_sql(source, name, by="candidate, label"):
    """CTE: exact area from average ranks."""
    return f"""{name} AS (
  SELECT {by}, CASE WHEN min(truth) = max(truth) THEN NULL ELSE
    (sum(r) FILTER (WHERE truth = 1) - sum(truth) * (sum(truth) + 1) / CAST(2 AS DOUBLE))
    / (CAST(sum(truth) AS DOUBLE) * CAST(sum(1 - truth) AS DOUBLE)) END AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score)
               + (count(*) OVER (PARTITION BY {by}, score) - 1) / CAST(2 AS DOUBLE) AS r FROM {source})
  GROUP BY {by})"""


AUC_SQL = SCORED_SQL + ", " + _auc_sql("scored", "auc")
FOLD_SCORED_SQL = FOLDED_CORPUS_SQL + ", " + scores_sql("folded", "doc_id, fold")
SUMMARY_SQL = FOLD_SCORED_SQL + f""", {_auc_sql("scored", "auc")}, {_auc_sql("scored", "fold_auc", "fold, candidate, label")},
per_fold AS (SELECT fold, candidate, avg(roc_auc) AS m FROM fold_auc GROUP BY ALL),
summary AS (
  SELECT o.candidate, o.m AS oof_mean_column_roc_auc, f.m AS fold_roc_auc_mean, f.s AS fold_roc_auc_standard_deviation
  FROM (SELECT candidate, avg(roc_auc) AS m FROM auc GROUP BY ALL) o
  JOIN (SELECT candidate, avg(m) AS m, stddev_samp(m) AS s FROM per_fold GROUP BY ALL) f ON o.candidate = f.candidate)"""


def _fraction_sql(source, name):
    return f"""{name} AS (
  SELECT *, (rank() OVER (PARTITION BY candidate, label ORDER BY score)
    + (count(*) OVER (PARTITION BY candidate, label, score) - 1) / CAST(2 AS DOUBLE))
    / (count(*) OVER (PARTITION BY candidate, label) + CAST(1 AS DOUBLE)) AS fraction FROM {source})"""




EXTREME_SQL = (
    f"WITH {CORPUS_SQL}, "
    + scores_sql("corpus", "doc_id, n_chars")
    + ", extreme AS (SELECT doc_id, candidate, label, truth, list_extract(["
    + ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in EXTREMES)
    + f"], CAST(n_chars % {len(EXTREMES)} + 1 AS INTEGER)) * (1 + n_chars % 3) AS score FROM scored WHERE candidate = 'spread')"
)


def _pool_sql(pool):
    rows = ", ".join(
        f"({i}, " + ", ".join(f"CAST('{w!r}' AS DOUBLE)" for w in row) + ")" for i, row in enumerate(pool)
    )
    return f"pool(pool_id, w0, w1, w2) AS (SELECT * FROM (VALUES {rows}))"


POOL_SQL = _pool_sql(bl.weight_pool(3, draws=0))
HALVES_SQL = GROUPS_SQL + f""", {holdout_sql("grouped", "halved", 0.5, SEED + 202)},
halves AS (SELECT k.*, h.held_out FROM keyed k JOIN halved h ON k.group_key = h.group_key),
optimisation AS (SELECT * FROM halves WHERE NOT held_out), audit AS (SELECT * FROM halves WHERE held_out)"""
SEARCH_SQL = HALVES_SQL + ", " + scores_sql("optimisation") + f""", {_fraction_sql("scored", "ranked")},
{POOL_SQL}, wide AS (
  SELECT doc_id, label, max(truth) AS truth, max(fraction) FILTER (WHERE candidate = 'spread') AS r0,
    max(fraction) FILTER (WHERE candidate = 'scattered') AS r1, max(fraction) FILTER (WHERE candidate = 'tied') AS r2
  FROM ranked GROUP BY ALL),
blended AS (SELECT p.pool_id, w.label, w.truth, r0 * w0 + r1 * w1 + r2 * w2 AS score FROM wide w, pool p),
{_auc_sql("blended", "pool_auc", "pool_id, label")}"""
GLOBAL_SQL = SEARCH_SQL + """, found AS (
  SELECT p.*, a.roc_auc FROM pool p JOIN (SELECT pool_id, avg(roc_auc) AS roc_auc FROM pool_auc GROUP BY ALL) a
    ON p.pool_id = a.pool_id ORDER BY a.roc_auc DESC, p.pool_id LIMIT 1)"""
PER_LABEL_SQL = SEARCH_SQL + """, found AS (
  SELECT a.label, p.*, a.roc_auc FROM pool p JOIN (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY roc_auc DESC, pool_id) AS place FROM pool_auc) a
    ON p.pool_id = a.pool_id WHERE a.place = 1)"""
WEIGHT_COLUMNS = "CAST(pool_id AS BIGINT) AS pool_id, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2"
TEST_SQL = f"""WITH {UNLABELLED_SQL}, scored AS (
  SELECT doc_id, n_chars, CAST(n_chars % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS s FROM unlabelled)"""

AUDITED_SQL = f"""{GLOBAL_SQL}, {scores_sql("audit").replace("scored AS", "audit_scored AS", 1)},
{_fraction_sql("audit_scored", "audit_ranked")}, audit_blended AS (
  SELECT doc_id, label, max(truth) AS truth, sum(fraction * CASE candidate WHEN 'spread' THEN w0
    WHEN 'scattered' THEN w1 ELSE w2 END) AS score FROM audit_ranked, found GROUP BY ALL),
{_auc_sql("audit_blended", "blend_auc", "label")},
{_auc_sql("audit_scored", "audit_auc")}, both_auc AS (
  SELECT (SELECT avg(roc_auc) FROM blend_auc) AS b, (SELECT avg(roc_auc) FROM audit_auc WHERE candidate = 'spread') AS s)"""

ORACLES = {
    "roc_auc_extreme_scores": f"""{EXTREME_SQL}, {_auc_sql("extreme", "auc")}
SELECT candidate, label, round(roc_auc, 6) AS roc_auc FROM auc""",
    "fractional_ranks_extreme_scores": f"""{EXTREME_SQL}, {_fraction_sql("extreme", "ranked")}
SELECT doc_id, label, round(fraction, 6) AS fraction FROM ranked""",
    "attach_truth": f"WITH {SCORED_SQL} SELECT doc_id, label, candidate, round(score, 6) AS score, CAST(truth AS BIGINT) AS truth FROM scored",
    "threshold_labels": f"WITH {SCORED_SQL} SELECT doc_id, candidate, label, CAST(score >= 0.5 AS BIGINT) AS prediction FROM scored",
    "confusion": f"WITH {CONFUSION_SQL} SELECT * FROM confused",
    "label_metrics": f"""WITH {LABEL_METRICS_SQL} SELECT candidate, label, tp, fp, fn, tn, round(accuracy, 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM measured""",
    "element_accuracy": f"WITH {SCORED_SQL} SELECT candidate, round(avg(CAST((score >= 0.5) = (truth = 1) AS INT)), 6) AS element_wise_accuracy FROM scored GROUP BY ALL",
    "subset_accuracy": f"""WITH {SCORED_SQL} SELECT candidate, round(avg(ok), 6) AS subset_accuracy FROM (
  SELECT candidate, doc_id, min(CAST((score >= 0.5) = (truth = 1) AS INT)) AS ok FROM scored GROUP BY ALL) GROUP BY ALL""",
    "macro_metrics": f"""WITH {LABEL_METRICS_SQL} SELECT candidate, round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM measured GROUP BY ALL""",
    "micro_metrics": f"""WITH {CONFUSION_SQL} SELECT candidate, round({_ratio("sum(tp)", "sum(tp + fp)")}, 6) AS micro_precision,
  round({_ratio("sum(tp)", "sum(tp + fn)")}, 6) AS micro_recall,
  round({_ratio("2 * sum(tp)", "sum(2 * tp + fp + fn)")}, 6) AS micro_f1 FROM confused GROUP BY ALL""",
    "roc_auc": f"WITH {AUC_SQL} SELECT candidate, label, round(roc_auc, 6) AS roc_auc FROM auc",
    "mean_column_auc": f"WITH {AUC_SQL} SELECT candidate, round(avg(roc_auc), 6) AS mean_column_roc_auc FROM auc GROUP BY ALL",
    "rank_auc_only": f"""WITH {AUC_SQL} SELECT candidate, label, round(roc_auc, 6) AS roc_auc,
  round(avg(roc_auc) OVER (PARTITION BY candidate), 6) AS mean_column_roc_auc FROM auc""",
    "per_label_table": f"""WITH {LABEL_METRICS_SQL}, {_auc_sql("scored", "auc")}
SELECT m.candidate, m.label, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(a.roc_auc, 6) AS roc_auc
FROM measured m JOIN auc a ON m.candidate = a.candidate AND m.label = a.label""",
    "all_metrics": f"""WITH {LABEL_METRICS_SQL}, {_auc_sql("scored", "auc")},
pooled AS (
  SELECT candidate, avg(accuracy) AS element_wise_accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
    avg(f1) AS macro_f1, {_ratio("sum(tp)", "sum(tp + fp)")} AS micro_precision,
    {_ratio("sum(tp)", "sum(tp + fn)")} AS micro_recall, {_ratio("2 * sum(tp)", "sum(2 * tp + fp + fn)")} AS micro_f1
  FROM measured GROUP BY ALL),
subsets AS (SELECT candidate, avg(ok) AS subset_accuracy FROM (
  SELECT candidate, doc_id, min(CAST((score >= 0.5) = (truth = 1) AS INT)) AS ok FROM scored GROUP BY ALL) GROUP BY ALL),
areas AS (SELECT candidate, avg(roc_auc) AS mean_column_roc_auc FROM auc GROUP BY ALL)
SELECT p.candidate, round(element_wise_accuracy, 6) AS element_wise_accuracy, round(subset_accuracy, 6) AS subset_accuracy,
  round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1,
  round(micro_precision, 6) AS micro_precision, round(micro_recall, 6) AS micro_recall, round(micro_f1, 6) AS micro_f1,
  round(mean_column_roc_auc, 6) AS mean_column_roc_auc
FROM pooled p JOIN subsets s ON p.candidate = s.candidate JOIN areas a ON p.candidate = a.candidate""",
    "fold_summary": f"""WITH {SUMMARY_SQL} SELECT candidate, round(oof_mean_column_roc_auc, 6) AS oof_mean_column_roc_auc,
  round(fold_roc_auc_mean, 6) AS fold_roc_auc_mean,
  round(fold_roc_auc_standard_deviation, 6) AS fold_roc_auc_standard_deviation FROM summary""",
    "rank_candidates": f"""WITH {SUMMARY_SQL} SELECT row_number() OVER (
  ORDER BY fold_roc_auc_mean DESC, oof_mean_column_roc_auc DESC, candidate) AS position, candidate FROM summary""",
    "auc_pivot": f"""WITH {AUC_SQL} SELECT candidate, round(max(roc_auc) FILTER (WHERE label = 'toxic'), 6) AS toxic,
  round(max(roc_auc) FILTER (WHERE label = 'low_quality'), 6) AS low_quality FROM auc GROUP BY ALL""",
    "fractional_ranks": f"""WITH {SCORED_SQL}, {_fraction_sql("scored", "ranked")}
SELECT doc_id, candidate, label, round(fraction, 6) AS fraction FROM ranked""",
    "search_weights": f"WITH {GLOBAL_SQL} SELECT {WEIGHT_COLUMNS}, round(roc_auc, 6) AS roc_auc FROM found",
    "search_weights_drawn": f"""WITH {GLOBAL_SQL.replace(POOL_SQL, _pool_sql(DRAWN))}
SELECT {WEIGHT_COLUMNS}, round(roc_auc, 6) AS roc_auc FROM found""",
    "search_weights_per_label": f"WITH {PER_LABEL_SQL} SELECT label, {WEIGHT_COLUMNS}, round(roc_auc, 6) AS roc_auc FROM found",
    "blend_weights_table": f"""WITH {PER_LABEL_SQL} SELECT label, 'spread' AS candidate, round(w0, 6) AS weight FROM found
UNION ALL SELECT label, 'scattered', round(w1, 6) FROM found UNION ALL SELECT label, 'tied', round(w2, 6) FROM found""",
    "check_weights": f"""WITH {GLOBAL_SQL} SELECT CAST(2 AS BIGINT) AS labels,
  CAST(2 * count(*) FILTER (WHERE abs(w0 + w1 + w2 - 1) > 1e-8) AS BIGINT) AS labels_off_one FROM found""",
    "apply_weights": f"""WITH {SCORED_SQL}, {_fraction_sql("scored", "ranked")}
SELECT doc_id, label, round(least(greatest(sum(fraction * CASE candidate WHEN 'spread' THEN CAST(0.5 AS DOUBLE)
  WHEN 'scattered' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END), 1e-15), 1 - 1e-15), 6) AS score FROM ranked GROUP BY ALL""",
    "audit_blend": f"""WITH {AUDITED_SQL}
SELECT round(b, 6) AS blend_auc, round(s, 6) AS best_single_auc, b > s AS accepted FROM both_auc""",
    "blend_audit_per_label": f"""WITH {AUDITED_SQL}
SELECT 'rank_blend' AS candidate, label, round(roc_auc, 6) AS roc_auc FROM blend_auc""",
    "blend_results": f"""WITH {AUDITED_SQL}, single AS (SELECT * FROM audit_scored WHERE candidate = 'spread'),
cells AS (SELECT label, count(*) FILTER (WHERE score >= 0.5 AND truth = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND truth = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND truth = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND truth = 0) AS tn FROM single GROUP BY ALL),
macro AS (SELECT avg({_ratio("tp", "(tp + fp)")}) AS p, avg({_ratio("tp", "(tp + fn)")}) AS r, avg({_ratio("2 * tp", "(2 * tp + fp + fn)")}) AS f FROM cells),
micro AS (SELECT {_ratio("sum(tp + tn)", "sum(tp + fp + fn + tn)")} AS e, {_ratio("sum(tp)", "sum(tp + fp)")} AS p, {_ratio("sum(tp)", "sum(tp + fn)")} AS r,
  {_ratio("2 * sum(tp)", "sum(2 * tp + fp + fn)")} AS f FROM cells),
whole AS (SELECT avg(ok) AS ok FROM (SELECT doc_id, min(CAST((score >= 0.5) = (truth = 1) AS INT)) AS ok FROM single GROUP BY ALL))
SELECT 'optimisation' AS partition, 'rank_blend' AS candidate, round(roc_auc, 6) AS mean_column_roc_auc, CAST(NULL AS VARCHAR) AS metric_scope,
  CAST(NULL AS BOOLEAN) AS accepted, {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in bl.THRESHOLDED)} FROM found
UNION ALL SELECT 'audit', 'rank_blend', round(b, 6), 'roc_auc', b > s, {", ".join(["NULL"] * len(bl.THRESHOLDED))} FROM both_auc
UNION ALL SELECT 'audit', 'spread', round(s, 6), 'all', NOT b > s, round(micro.e, 6), round(ok, 6), round(macro.p, 6), round(macro.r, 6),
  round(macro.f, 6), round(micro.p, 6), round(micro.r, 6), round(micro.f, 6) FROM both_auc, macro, micro, whole""",
    "clip_scores": f"""WITH {SCORED_SQL}, clipped AS (SELECT doc_id, candidate, label,
  least(greatest(score, CAST(1e-15 AS DOUBLE)), 1 - CAST(1e-15 AS DOUBLE)) AS score FROM scored)
SELECT doc_id, candidate, label, score > 0 AS above_zero, score < 1 AS below_one, round(score, 6) AS score FROM clipped""",
    "score_margin": f"""WITH {CORPUS_SQL}, margins AS (
  SELECT doc_id, CAST(n_chars % 2001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(10 AS DOUBLE) AS m FROM corpus)
SELECT doc_id, round(0.5 + atan(m) / pi(), 6) AS score, round(1 / (1 + exp(-m)), 6) AS probability FROM margins""",
    "align_to_template": f"""{TEST_SQL} SELECT doc_id, -doc_id AS row_pos, round(s, 6) AS toxic, round(1 - s, 6) AS low_quality FROM scored""",
    "check_submission": f"""{TEST_SQL} SELECT count(*) AS rows, 2 * count(*) FILTER (WHERE n_chars % 2 <> 0) AS missing_scores,
  CAST(0 AS BIGINT) AS non_finite_scores, CAST(0 AS BIGINT) AS out_of_range_scores, CAST(0 AS BIGINT) AS row_difference FROM scored""",
}
