"""Tables and SQL fragments shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.operators.groups import group_table, with_group_key
from labelloom.operators.splits import assign_rows, stratified_group_folds
from labelloom.sources.spread import spread
from labelloom.staging import stage

LABELS = ("toxic", "low_quality")
SEED = 42
FOLDS = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "n_chars"), "doc_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents: ``doc_id, text, n_chars, toxic, low_quality``."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic", (1 - F.col("quality")).alias("low_quality"))
    return documents(spark, sf).join(labels, "doc_id")


def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti")


def keyed_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return with_group_key(corpus(spark, sf), "text")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return stage(group_table(keyed_corpus(spark, sf), "doc_id", LABELS), "groups")


def folded_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents with ``fold``, whole groups dealt out in turn."""
    folds = stratified_group_folds(groups(spark, sf), FOLDS, SEED, LABELS, method="rotate")
    return assign_rows(keyed_corpus(spark, sf), folds, ["fold"], "doc_id")


CANDIDATES = ("spread", "scattered", "tied")


def stand_in_scores(rows: DataFrame) -> DataFrame:
    """Scores from arithmetic on ids and lengths, so that metrics can be checked exactly."""
    scores = F.array(
        F.struct(F.lit("spread").alias("candidate"), ((F.col("n_chars") % 997) / 997.0).alias("score")),
        F.struct(F.lit("scattered").alias("candidate"), ((F.col("doc_id") * 7919) % 1009 / 1009.0).alias("score")),
        F.struct(F.lit("tied").alias("candidate"), ((F.col("n_chars") % 7) / 7.0).alias("score")),
    )
    truths = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("truth")) for c in LABELS])
    keep = [c for c in ("doc_id", "fold") if c in rows.columns]
    return rows.select(*keep, F.inline(scores), truths.alias("truths")).select(
        *keep, "candidate", "score", F.inline("truths")
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def bigints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


TOKEN_SQL = r"[\p{L}\p{N}_]+(?:''+[\p{L}\p{N}_]+)*"
TOKENS_SQL = "regexp_extract_all({text}, '" + TOKEN_SQL + "')"
FOLDED_SQL = "strip_accents(lower({text}))"
SENTENCES_SQL = (
    r"CASE WHEN regexp_matches({text}, '\S') THEN greatest(1, len(list_filter(string_split("
    r"regexp_replace(regexp_replace({text}, '[.!?]+(\s|$)', chr(1) || '\1', 'g'), '\n+', chr(1), 'g'), chr(1)),"
    r" lambda p: regexp_matches(p, '\S')))) ELSE 0 END"
)
CORPUS_SQL = """corpus AS (
  SELECT d.doc_id, d.text, d.n_chars, l.toxic, 1 - l.quality AS low_quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
KEYED_SQL = CORPUS_SQL + r""", keyed AS (
  SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS group_key FROM corpus)"""
GROUPS_SQL = KEYED_SQL + """, grouped AS (
  SELECT group_key, min(doc_id) AS group_id, count(*) AS group_size, max(toxic) AS toxic,
         max(low_quality) AS low_quality,
         min(toxic + 2 * low_quality) <> max(toxic + 2 * low_quality) AS inconsistent
  FROM keyed GROUP BY group_key)"""


def ranked_sql(source: str, name: str, seed: int) -> str:
    """CTE: groups with their label vector and their place among the groups that share it."""
    return f"""{name} AS (
  SELECT *, toxic + 2 * low_quality AS signature,
         row_number() OVER (PARTITION BY toxic + 2 * low_quality
                            ORDER BY md5(concat('{seed}|', CAST(group_id AS VARCHAR))), group_id) AS place
  FROM {source})"""


def rotated_sql(source: str, name: str, seed: int, k: int) -> str:
    """CTE: groups dealt into ``k`` folds in turn."""
    return ranked_sql(source, f"{name}_ranked", seed) + f""", {name} AS (
  SELECT r.*, (place - 1 + (SELECT count(*) FROM {source} g WHERE g.toxic + 2 * g.low_quality < r.signature)) % {k} AS fold
  FROM {name}_ranked r)"""


FOLDED_CORPUS_SQL = (
    GROUPS_SQL
    + ", "
    + rotated_sql("grouped", "dealt", SEED, FOLDS)
    + """, folded AS (
  SELECT k.doc_id, k.text, k.n_chars, k.toxic, k.low_quality, k.group_key, d.fold
  FROM keyed k JOIN dealt d ON k.group_key = d.group_key)"""
)


def scores_sql(source: str, keep: str = "doc_id") -> str:
    """CTE ``scored`` with the stand-in scores of ``source``."""
    fields = ", ".join(f"r.{c.strip()}" for c in keep.split(","))
    return f"""scored AS (
  SELECT {fields}, c.candidate, l.label,
         CASE c.candidate WHEN 'spread' THEN CAST(n_chars % 997 AS DOUBLE) / CAST(997 AS DOUBLE)
                          WHEN 'scattered' THEN CAST((doc_id * 7919) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE)
                          ELSE CAST(n_chars % 7 AS DOUBLE) / CAST(7 AS DOUBLE) END AS score,
         CASE l.label WHEN 'toxic' THEN toxic ELSE low_quality END AS truth
  FROM {source} r, (VALUES ('spread'), ('scattered'), ('tied')) c(candidate),
       (VALUES ('toxic'), ('low_quality')) l(label))"""
