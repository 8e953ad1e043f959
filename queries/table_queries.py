"""Checks, duplicate groups, splits and the class profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import checks, groups as gr, profile, splits
from labelloom.plans import experiment as ex
from queries.common import (
    CORPUS_SQL,
    FOLDED_CORPUS_SQL,
    FOLDED_SQL,
    FOLDS,
    GROUPS_SQL,
    KEYED_SQL,
    LABELS,
    SEED,
    SENTENCES_SQL,
    TOKEN_SQL,
    bigints,
    corpus,
    documents,
    folded_corpus,
    groups,
    keyed_corpus,
    ranked_sql,
    rounded,
    table,
    unlabelled,
)
from queries.text_queries import STOP_LIST


def check_ids(spark, sf):
    return checks.check_ids(table(spark, sf, "documents"), "doc_id")


def check_ids_repeated(spark, sf):
    return checks.check_ids(table(spark, sf, "conversations"), "conv_id")


def check_labels(spark, sf):
    return checks.check_labels(corpus(spark, sf), LABELS)


def clean_text(spark, sf):
    cleaned = checks.clean_text(table(spark, sf, "documents"), "text")
    return cleaned.select("doc_id", F.md5("text").alias("digest"))


def clean_text_report(spark, sf):
    # Labels without a document would have no text.
    texts = table(spark, sf, "documents").select("doc_id", "text")
    joined = texts.join(
        table(spark, sf, "labels").select("doc_id").withColumn("labelled", F.lit(True)), "doc_id", "left"
    ).select("doc_id", F.when(F.col("labelled"), F.col("text")).alias("text"))
    return checks.text_report(joined, "text")


def check_reconcile(spark, sf):
    return checks.check_reconcile(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def prepare_tables(spark, sf):
    """The checked tables of an experiment, as one: documents with labels, those without, and their template."""
    settings = ex.Settings("doc_id", "text", LABELS)
    test = unlabelled(spark, sf)
    tables = ex.prepare_tables(corpus(spark, sf), settings, test, test.select("doc_id"))
    text = {name: F.md5("text") if "text" in df.columns else F.lit(None).cast("string") for name, df in tables.items()}
    parts = [df.select(F.lit(name).alias("part"), "doc_id", text[name].alias("digest")) for name, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sample_rows(spark, sf):
    sampled = checks.sample_rows(corpus(spark, sf), 100, SEED, "doc_id", LABELS, floor=1)
    return bigints(sampled.select("doc_id", *LABELS), *LABELS)


def duplicate_groups(spark, sf):
    keyed = keyed_corpus(spark, sf)
    rows = gr.duplicate_groups(keyed, gr.group_table(keyed, "doc_id", LABELS), "doc_id")
    return rows.select("doc_id", "group_id", "group_size")


def duplicate_groups_documents(spark, sf):
    keyed = gr.with_group_key(documents(spark, sf).select("doc_id", "text"), "text")
    rows = gr.duplicate_groups(keyed, gr.group_table(keyed.withColumn("none", F.lit(0)), "doc_id", ["none"]), "doc_id")
    return rows.select("doc_id", "group_id", "group_size")


def group_labels(spark, sf):
    return bigints(groups(spark, sf).select("group_id", *LABELS), *LABELS)


def group_sizes(spark, sf):
    return groups(spark, sf).select("group_id", "group_size")


def label_signature(spark, sf):
    return corpus(spark, sf).select("doc_id", gr.label_signature(LABELS).alias("signature"))


def duplicate_report(spark, sf):
    return gr.duplicate_report(groups(spark, sf))


def stratified_group_folds(spark, sf):
    folds = splits.stratified_group_folds(groups(spark, sf), FOLDS, SEED, LABELS)
    return bigints(folds.select("group_id", "group_size", *LABELS, "fold"), "fold", *LABELS)


def stratified_group_folds_sizes(spark, sf):
    """Smallest and largest number of groups of each label vector in a fold: they differ by one at most."""
    folds = splits.stratified_group_folds(groups(spark, sf), FOLDS, SEED, LABELS)
    sizes = folds.groupBy(gr.label_signature(LABELS).alias("signature")).pivot("fold", list(range(FOLDS))).count()
    counts = [F.coalesce(F.col(str(f)), F.lit(0)) for f in range(FOLDS)]
    return sizes.select("signature", F.least(*counts).alias("smallest"), F.greatest(*counts).alias("largest"))


def stratified_group_folds_rotate(spark, sf):
    return bigints(folded_corpus(spark, sf).select("doc_id", "fold"), "fold")


def stratified_group_holdout(spark, sf):
    held = splits.stratified_group_holdout(groups(spark, sf), 0.16, SEED + 101, LABELS)
    return held.select("group_id", "held_out")


def split_groups(spark, sf):
    plan = splits.split_groups(groups(spark, sf), FOLDS, SEED, LABELS, meta_fraction=0.16)
    rows = splits.assign_rows(keyed_corpus(spark, sf), plan, ["partition", "fold"], "doc_id")
    return bigints(rows.select("doc_id", "partition", "fold"), "fold")


def split_partitions(spark, sf):
    return split_groups(spark, sf).select("doc_id", "partition")


def rows_for_groups(spark, sf):
    selected = groups(spark, sf).where("toxic = 1")
    return splits.rows_for_groups(keyed_corpus(spark, sf), selected, "doc_id").select("doc_id")


def check_no_group_crosses(spark, sf):
    return checks.check_no_group_crosses(folded_corpus(spark, sf), "group_key", "fold")


def check_no_group_crosses_by_row(spark, sf):
    """Folds by row instead of by group, so that duplicate groups do cross."""
    by_row = keyed_corpus(spark, sf).withColumn("fold", F.col("doc_id") % FOLDS)
    return checks.check_no_group_crosses(by_row, "group_key", "fold")


def check_both_outcomes(spark, sf):
    return bigints(checks.check_both_outcomes(folded_corpus(spark, sf), "fold", LABELS), "fold")


def check_coverage(spark, sf):
    return checks.check_coverage(table(spark, sf, "documents"), folded_corpus(spark, sf), "doc_id")


def check_two_outcomes(spark, sf):
    return checks.check_two_outcomes(corpus(spark, sf), LABELS)


def class_membership(spark, sf):
    return profile.class_membership(corpus(spark, sf), LABELS).select("doc_id", "class")


def class_summary(spark, sf):
    summary = profile.class_summary(corpus(spark, sf), "text", LABELS)
    doubles = [name for name, kind in summary.dtypes if kind == "double"]
    return rounded(summary, *doubles)


def top_words_by_class(spark, sf):
    return bigints(profile.top_words_by_class(corpus(spark, sf), "text", LABELS), "rank", "frequency")


def top_words_small_vocabulary(spark, sf):
    top = profile.top_words_by_class(corpus(spark, sf), "text", LABELS, k=40, min_df=3, vocabulary_limit=150)
    return bigints(top, "rank", "frequency")


def corpus_totals(spark, sf):
    return profile.corpus_totals(documents(spark, sf), "text")


QUERIES = {
    f.__name__: f
    for f in (
        check_ids, check_ids_repeated, check_labels, clean_text, clean_text_report, check_reconcile, prepare_tables,
        sample_rows, duplicate_groups, duplicate_groups_documents, group_labels, group_sizes,
        label_signature, duplicate_report, stratified_group_folds, stratified_group_folds_sizes, stratified_group_folds_rotate,
        stratified_group_holdout, split_groups, split_partitions, rows_for_groups, check_no_group_crosses,
        check_no_group_crosses_by_row, check_both_outcomes, check_coverage, check_two_outcomes,
        class_membership, class_summary, top_words_by_class, top_words_small_vocabulary, corpus_totals,
    )
}


def _check_ids_sql(source, column):
    return f"""SELECT CAST(sum(n) AS BIGINT) AS rows,
  CAST(coalesce(sum(n) FILTER (WHERE id IS NULL), 0) AS BIGINT) AS null_ids,
  count(id) AS distinct_ids,
  CAST(coalesce(sum(n) FILTER (WHERE id IS NOT NULL AND n > 1), 0) AS BIGINT) AS repeated_id_rows
FROM (SELECT CAST({column} AS VARCHAR) AS id, count(*) AS n FROM {source} GROUP BY 1)"""


def _crossing_sql(ctes, source, fold):
    return f"""WITH {ctes} SELECT count(*) AS groups, count(*) FILTER (WHERE parts > 1) AS crossing_groups
FROM (SELECT group_key, count(DISTINCT {fold}) AS parts FROM {source} GROUP BY group_key)"""


CLASSES_SQL = CORPUS_SQL + """, classed AS (
  SELECT doc_id, text, 'toxic' AS class FROM corpus WHERE toxic = 1
  UNION ALL SELECT doc_id, text, 'low_quality' FROM corpus WHERE low_quality = 1
  UNION ALL SELECT doc_id, text, 'clean' FROM corpus WHERE toxic = 0 AND low_quality = 0)"""


def _top_words_sql(k, min_df, limit):
    return f"""WITH {CLASSES_SQL}, words AS (
  SELECT doc_id, unnest(regexp_extract_all({FOLDED_SQL.format(text="text")}, '{TOKEN_SQL}')) AS word FROM corpus),
kept AS (SELECT doc_id, word FROM words WHERE length(word) >= 2 AND word NOT IN ({STOP_LIST})),
vocabulary AS (
  SELECT word FROM kept GROUP BY word HAVING count(DISTINCT doc_id) >= {min_df}
  ORDER BY count(*) DESC, word LIMIT {limit}),
counted AS (
  SELECT c.class, k.word, count(*) AS frequency
  FROM kept k JOIN vocabulary v ON k.word = v.word JOIN classed c ON c.doc_id = k.doc_id GROUP BY 1, 2),
ranked AS (
  SELECT class, word, frequency, row_number() OVER (PARTITION BY class ORDER BY frequency DESC, word DESC) AS rank
  FROM counted)
SELECT class, CAST(rank AS BIGINT) AS rank, word, CAST(frequency AS BIGINT) AS frequency FROM ranked WHERE rank <= {k}"""


def holdout_sql(source, name, fraction, seed):
    """CTE: a share of the groups per label vector, leftovers by largest fractional part."""
    share = f"n * CAST({fraction} AS DOUBLE)"
    return ranked_sql(source, f"{name}_ranked", seed) + f""", {name}_quota AS (
  SELECT signature, floor({share}) + CASE WHEN row_number() OVER (ORDER BY {share} - floor({share}) DESC, signature)
      <= round(sum(n) OVER () * CAST({fraction} AS DOUBLE)) - sum(floor({share})) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT signature, count(*) AS n FROM {name}_ranked GROUP BY signature)),
{name} AS (
  SELECT r.* EXCLUDE (signature, place), r.place <= q.quota AS held_out
  FROM {name}_ranked r JOIN {name}_quota q ON r.signature = q.signature)"""


ORACLES = {
    "check_ids": _check_ids_sql("documents", "doc_id"),
    "check_ids_repeated": _check_ids_sql("conversations", "conv_id"),
    "check_labels": f"""WITH {CORPUS_SQL} SELECT count(*) AS rows,
  count(*) FILTER (WHERE coalesce(toxic NOT IN (0, 1), true)) AS invalid_toxic,
  count(*) FILTER (WHERE coalesce(low_quality NOT IN (0, 1), true)) AS invalid_low_quality FROM corpus""",
    "clean_text": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "clean_text_report": """SELECT count(*) AS rows, count(*) FILTER (WHERE l.doc_id IS NULL OR d.text IS NULL) AS null_texts
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "prepare_tables": """WITH parts AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part, d.doc_id,
  md5(coalesce(text, '')) AS digest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT * FROM parts UNION ALL SELECT 'template', doc_id, NULL FROM parts WHERE part = 'unlabelled'""",
    "check_reconcile": """SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left,
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right,
  abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels)) AS row_difference""",
    "sample_rows": f"""WITH {CORPUS_SQL}, picked AS (
  SELECT *, md5(concat('{SEED}|', CAST(doc_id AS VARCHAR))) AS pick FROM corpus),
sampled AS (SELECT * FROM picked ORDER BY pick, doc_id LIMIT 100),
extra AS (
  SELECT * FROM (SELECT * FROM picked WHERE toxic = 1 AND (SELECT sum(toxic) FROM sampled) = 0 ORDER BY pick LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT * FROM picked WHERE low_quality = 1 AND (SELECT sum(low_quality) FROM sampled) = 0
                 ORDER BY pick LIMIT 1))
SELECT DISTINCT doc_id, CAST(toxic AS BIGINT) AS toxic, CAST(low_quality AS BIGINT) AS low_quality
FROM (SELECT * FROM sampled UNION ALL SELECT * FROM extra)""",
    "duplicate_groups": f"""WITH {KEYED_SQL} SELECT doc_id, min(doc_id) OVER (PARTITION BY group_key) AS group_id,
  count(*) OVER (PARTITION BY group_key) AS group_size FROM keyed""",
    "duplicate_groups_documents": r"""SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS group_id,
  count(*) OVER (PARTITION BY k) AS group_size
FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM documents)""",
    "group_labels": f"""WITH {GROUPS_SQL} SELECT group_id, CAST(toxic AS BIGINT) AS toxic,
  CAST(low_quality AS BIGINT) AS low_quality FROM grouped""",
    "group_sizes": f"WITH {GROUPS_SQL} SELECT group_id, group_size FROM grouped",
    "label_signature": f"WITH {CORPUS_SQL} SELECT doc_id, CAST(toxic + 2 * low_quality AS BIGINT) AS signature FROM corpus",
    "duplicate_report": f"""WITH {GROUPS_SQL} SELECT CAST(sum(group_size) AS BIGINT) AS rows, count(*) AS groups,
  CAST(coalesce(sum(group_size) FILTER (WHERE group_size > 1), 0) AS BIGINT) AS rows_in_non_singleton_groups,
  count(*) FILTER (WHERE inconsistent) AS groups_with_inconsistent_labels FROM grouped""",
    "stratified_group_folds_sizes": f"""WITH {GROUPS_SQL} SELECT CAST(toxic + 2 * low_quality AS BIGINT) AS signature,
  CAST(count(*) // {FOLDS} AS BIGINT) AS smallest, CAST((count(*) + {FOLDS - 1}) // {FOLDS} AS BIGINT) AS largest
FROM grouped GROUP BY toxic + 2 * low_quality""",
    "split_partitions": f"""WITH {GROUPS_SQL}, {holdout_sql("grouped", "held", 0.16, SEED + 101)},
meta AS (SELECT * EXCLUDE (held_out) FROM held WHERE held_out), {holdout_sql("meta", "audited", 0.5, SEED + 202)},
parts AS (
  SELECT group_key, 'dev' AS partition FROM held WHERE NOT held_out
  UNION ALL SELECT group_key, CASE WHEN held_out THEN 'meta_audit' ELSE 'meta_opt' END FROM audited)
SELECT k.doc_id, p.partition FROM keyed k JOIN parts p ON k.group_key = p.group_key""",
    "stratified_group_folds_rotate": f"WITH {FOLDED_CORPUS_SQL} SELECT doc_id, CAST(fold AS BIGINT) AS fold FROM folded",
    "stratified_group_holdout": f"""WITH {GROUPS_SQL}, {holdout_sql("grouped", "held", 0.16, SEED + 101)}
SELECT group_id, held_out FROM held""",
    "rows_for_groups": f"""WITH {GROUPS_SQL} SELECT doc_id FROM keyed
WHERE group_key IN (SELECT group_key FROM grouped WHERE toxic = 1)""",
    "check_no_group_crosses": _crossing_sql(FOLDED_CORPUS_SQL, "folded", "fold"),
    "check_no_group_crosses_by_row": _crossing_sql(KEYED_SQL, "keyed", f"doc_id % {FOLDS}"),
    "check_both_outcomes": f"""WITH {FOLDED_CORPUS_SQL}, cells AS (
  SELECT fold, 'toxic' AS label, toxic AS y FROM folded UNION ALL SELECT fold, 'low_quality', low_quality FROM folded),
counted AS (
  SELECT fold, label, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM cells GROUP BY ALL),
sides AS (
  SELECT *, CAST(sum(positives) OVER (PARTITION BY label) - positives AS BIGINT) AS other_positives,
         CAST(sum(negatives) OVER (PARTITION BY label) - negatives AS BIGINT) AS other_negatives FROM counted)
SELECT CAST(fold AS BIGINT) AS fold, label, positives, negatives, other_positives, other_negatives,
  positives > 0 AND negatives > 0 AND other_positives > 0 AND other_negatives > 0 AS has_both FROM sides""",
    "check_coverage": f"""WITH {FOLDED_CORPUS_SQL}, actual AS (SELECT doc_id, count(*) AS n FROM folded GROUP BY doc_id)
SELECT (SELECT count(*) FROM documents) AS expected_rows, (SELECT count(*) FROM folded) AS actual_rows,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM actual)) AS missing,
  (SELECT count(*) FROM actual WHERE n > 1) AS repeated,
  (SELECT count(*) FROM actual WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS unexpected""",
    "check_two_outcomes": f"""WITH {CORPUS_SQL}, counted AS (
  SELECT 'toxic' AS label, CAST(sum(toxic) AS BIGINT) AS positives, CAST(sum(1 - toxic) AS BIGINT) AS negatives FROM corpus
  UNION ALL
  SELECT 'low_quality', CAST(sum(low_quality) AS BIGINT), CAST(sum(1 - low_quality) AS BIGINT) FROM corpus)
SELECT *, positives > 0 AND negatives > 0 AS has_both FROM counted""",
    "class_membership": f"WITH {CLASSES_SQL} SELECT doc_id, class FROM classed",
    "class_summary": f"""WITH {CLASSES_SQL}, counted AS (
  SELECT class, len(regexp_extract_all(text, '{TOKEN_SQL}')) AS t, {SENTENCES_SQL.format(text="text")} AS s FROM classed)
SELECT class, count(*) AS comment_count,
  round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM corpus), 6) AS comment_prevalence,
  CAST(sum(s) AS BIGINT) AS sentence_like_units, CAST(sum(t) AS BIGINT) AS tokens,
  round(avg(s), 6) AS mean_sentence_like_units_per_comment, round(avg(t), 6) AS mean_tokens_per_comment,
  round(CAST(median(t) AS DOUBLE), 6) AS median_tokens_per_comment
FROM counted GROUP BY class""",
    "top_words_by_class": _top_words_sql(15, 2, 60000),
    "top_words_small_vocabulary": _top_words_sql(40, 3, 150),
    "corpus_totals": f"""SELECT count(*) AS total_comments,
  CAST(sum(len(regexp_extract_all(text, '{TOKEN_SQL}'))) AS BIGINT) AS total_tokens,
  CAST(sum({SENTENCES_SQL.format(text="text")}) AS BIGINT) AS total_sentence_like_units FROM documents""",
}
