"""Model fits, scoring and the assembled experiments over the labelled documents.

SQL cannot express the values: the tests check them by optimality, by exact solutions on small data and against plain fits. What
SQL can state of the tables of scores, who is in them, is in the queries named ``coverage``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import features as ft
from labelloom.operators.adapter import apply_adapter, fit_adapter
from labelloom.operators.linear import fit_linear_svm, fit_logistic, score_linear
from labelloom.operators.mlp import fit_mlp, score_multi
from labelloom.plans import experiment as ex
from labelloom.staging import fresh_path, stage
from queries.common import CORPUS_SQL, GROUPS_SQL, LABELS, SEED, bigints, corpus, rounded, unlabelled
from queries.feature_queries import UNLABELLED_SQL
from queries.table_queries import holdout_sql

SETTINGS = ex.Settings("doc_id", "text", LABELS)
WORDS, CHARS = SETTINGS.representations
#: The candidate that the query of one prediction table takes.
KEY = ex.candidate_key(CHARS, ex.SVM)


def _encoded(spark, sf):
    """Encoded documents with their labels, the size of the vocabulary and the number of rows."""
    rows = stage(corpus(spark, sf), "corpus")
    n = rows.count()
    terms = ft.with_terms(rows.select("doc_id", "text", *LABELS), "text", WORDS)
    vocab = ft.vocabulary(ft.term_counts(terms, False), n, WORDS.min_df, WORDS.max_df, WORDS.max_features)
    encoder = ft.fit_encoder(vocab, WORDS, n)
    return ft.encode(terms, encoder, ["doc_id", *LABELS]).persist(), encoder.size, n


def _linear_query(fit, c):
    def build(spark, sf):
        vectors, size, _ = _encoded(spark, sf)
        model = fit(vectors, LABELS, size, dict.fromkeys(LABELS, c))
        scores = stage(score_linear(vectors, model, ["doc_id"], "fitted"), "scores")
        vectors.unpersist()
        return scores

    return build


def _reduced(spark, sf):
    vectors, size, n = _encoded(spark, sf)
    adapter = fit_adapter(vectors, size, n, components=SETTINGS.components)
    dense = stage(apply_adapter(vectors, adapter, ["doc_id", *LABELS], n), "reduced")
    vectors.unpersist()
    return dense, adapter, n


def truncated_svd(spark, sf):
    """Singular values, means and deviations of the components."""
    _, adapter, _ = _reduced(spark, sf)
    rows = [
        (i, float(s), float(m), float(d))
        for i, (s, m, d) in enumerate(zip(adapter.singular_values, adapter.mean, adapter.deviation))
    ]
    return spark.createDataFrame(rows, "component int, singular_value double, mean double, deviation double")


def standard_scale(spark, sf):
    """Mean and population deviation of every scaled component: 0 and 1."""
    dense, _, _ = _reduced(spark, sf)
    cells = dense.select(F.posexplode("features").alias("component", "value"))
    # The features hold single precision.
    return cells.groupBy("component").agg(
        F.round(F.abs(F.avg("value")), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("deviation")
    )


def explained_variance(spark, sf):
    _, adapter, n = _reduced(spark, sf)
    return spark.createDataFrame(
        [(n, adapter.components, adapter.explained_variance)],
        "rows bigint, components int, explained_variance double",
    )


def apply_adapter_query(spark, sf):
    return _reduced(spark, sf)[0].select("doc_id", "features")


def _network(spark, sf):
    dense, adapter, n = _reduced(spark, sf)
    return dense, fit_mlp(dense, LABELS, "doc_id", adapter.components, max_epochs=SETTINGS.epochs)


def fit_mlp_query(spark, sf):
    _, network = _network(spark, sf)
    return spark.createDataFrame(
        [(network.epochs, network.final_loss, network.reached_epoch_budget)],
        "epochs int, final_loss double, reached_epoch_budget boolean",
    )


def score_multi_query(spark, sf):
    dense, network = _network(spark, sf)
    return score_multi(dense, network, ["doc_id"], "network")


def _split(spark, sf, meta=None):
    return ex.split_rows(corpus(spark, sf), 3, SETTINGS, meta_fraction=meta)


def _validated(spark, sf):
    """The comparison of all six candidates over the labelled documents."""
    return ex.cross_validate(_split(spark, sf), range(3), SETTINGS)


def cross_validate(spark, sf):
    return _validated(spark, sf).fold_results


def cross_validate_summary(spark, sf):
    return _validated(spark, sf).summary


def _told(scores):
    """What SQL can state of scores: that each is there once, and inside the unit interval."""
    inside = (F.col("score") >= 0) & (F.col("score") <= 1)
    return scores.withColumn("inside", inside).drop("score")


def oof_scores(spark, sf):
    scores = _validated(spark, sf).oof_scores.select("doc_id", "fold", "candidate", "label", "truth", "score")
    return bigints(rounded(scores, "score"), "fold", "truth")


def oof_coverage(spark, sf):
    """Every labelled document once per candidate and label."""
    return bigints(_told(_validated(spark, sf).oof_scores).select("doc_id", "candidate", "label", "truth", "inside"), "truth")


def _scored_parts(spark, sf):
    split = _split(spark, sf, meta=0.3)
    parts = {name: split.where(F.col("partition") == name) for name in ("meta_opt", "meta_audit")}
    scored = ex.fit_and_score(split.where("partition = 'dev'"), parts, SETTINGS)
    whole = scored["meta_opt"].withColumn("part", F.lit("meta_opt")).unionByName(
        scored["meta_audit"].withColumn("part", F.lit("meta_audit"))
    )
    return bigints(whole.select("part", "doc_id", "candidate", "label", "truth", "score"), "truth")


def fit_and_score(spark, sf):
    return rounded(_scored_parts(spark, sf), "score")


def fit_and_score_coverage(spark, sf):
    return _told(_scored_parts(spark, sf))


def _refitted(spark, sf):
    scores = ex.refit_and_score(corpus(spark, sf), unlabelled(spark, sf), SETTINGS.candidates(), SETTINGS)
    return scores.select("doc_id", "candidate", "label", "score")


def refit_and_score(spark, sf):
    return rounded(_refitted(spark, sf), "score")


def refit_coverage(spark, sf):
    return _told(_refitted(spark, sf))


def _blended(spark, sf):
    """The split, the best candidate of its dev rows, and the blend learned and audited on the others."""
    split = _split(spark, sf, meta=0.3)
    best = ex.cross_validate(split.where("partition = 'dev'"), range(3), SETTINGS).best
    return best, ex.learn_blend(split, best, SETTINGS)


def learn_blend(spark, sf):
    """The table of results of a blend of all six candidates against the best of the comparison."""
    return _blended(spark, sf)[1].results


def write_submissions(spark, sf):
    """The prediction tables of the best candidate and of the blend, written and read back."""
    template = unlabelled(spark, sf).select("doc_id", F.col("doc_id").alias("row_pos"))
    best, blend = _blended(spark, sf)
    tables = ex.submission_tables(corpus(spark, sf), unlabelled(spark, sf), template, best, SETTINGS, blend.weights)
    paths = ex.write_submissions(tables, fresh_path(spark, "submissions"), "doc_id", LABELS)
    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in LABELS)
    read = [spark.read.csv(path, schema=schema, header=True).withColumn("submission", F.lit(name)) for name, path in sorted(paths.items())]
    return rounded(read[0].unionByName(read[1]), *LABELS)


def submission_coverage(spark, sf):
    """The prediction table of one candidate, written and read back: a line for every id, all values in range."""
    template = unlabelled(spark, sf).select("doc_id", F.col("doc_id").alias("row_pos"))
    tables = ex.submission_tables(corpus(spark, sf), unlabelled(spark, sf), template, KEY, SETTINGS)
    paths = ex.write_submissions(tables, fresh_path(spark, "submissions"), "doc_id", LABELS)
    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in LABELS)
    written = spark.read.csv(paths["best_single"], schema=schema, header=True)
    return written.select("doc_id", *[F.col(c).between(0, 1).alias(c) for c in LABELS])


QUERIES = {
    "fit_logistic": _linear_query(fit_logistic, 4.0),
    "fit_linear_svm": _linear_query(fit_linear_svm, 0.5),
    "truncated_svd": truncated_svd,
    "standard_scale": standard_scale,
    "explained_variance": explained_variance,
    "apply_adapter": apply_adapter_query,
    "fit_mlp": fit_mlp_query,
    "score_multi": score_multi_query,
    "cross_validate": cross_validate,
    "cross_validate_summary": cross_validate_summary,
    "oof_scores": oof_scores,
    "oof_coverage": oof_coverage,
    "fit_and_score": fit_and_score,
    "fit_and_score_coverage": fit_and_score_coverage,
    "refit_and_score": refit_and_score,
    "refit_coverage": refit_coverage,
    "learn_blend": learn_blend,
    "write_submissions": write_submissions,
    "submission_coverage": submission_coverage,
}
CANDIDATES_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in SETTINGS.candidates()) + ") c(candidate)"
LABELS_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in LABELS) + ") l(label)"
PARTS_SQL = GROUPS_SQL + f""", {holdout_sql("grouped", "meta", 0.3, SEED + 101)},
meta_groups AS (SELECT group_key, group_id, group_size, toxic, low_quality, inconsistent FROM meta WHERE held_out),
{holdout_sql("meta_groups", "audited", 0.5, SEED + 202)}"""
ORACLES = {
    "standard_scale": """SELECT CAST(unnest(range((SELECT least(192, count(*) - 1) FROM documents JOIN labels USING (doc_id)))) AS INTEGER)
  AS component, CAST(0 AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS deviation""",
    "oof_coverage": f"""WITH {CORPUS_SQL} SELECT doc_id, candidate, label,
  CAST(CASE label WHEN 'toxic' THEN toxic ELSE low_quality END AS BIGINT) AS truth, true AS inside FROM corpus, {CANDIDATES_SQL}, {LABELS_SQL}""",
    "fit_and_score_coverage": f"""WITH {PARTS_SQL} SELECT CASE WHEN a.held_out THEN 'meta_audit' ELSE 'meta_opt' END AS part, k.doc_id, candidate, label,
  CAST(CASE label WHEN 'toxic' THEN k.toxic ELSE k.low_quality END AS BIGINT) AS truth, true AS inside
FROM keyed k JOIN audited a ON k.group_key = a.group_key, {CANDIDATES_SQL}, {LABELS_SQL}""",
    "refit_coverage": f"""WITH {UNLABELLED_SQL} SELECT doc_id, candidate, label, true AS inside FROM unlabelled, {CANDIDATES_SQL}, {LABELS_SQL}""",
    "submission_coverage": f"WITH {UNLABELLED_SQL} SELECT doc_id, true AS toxic, true AS low_quality FROM unlabelled",
}
