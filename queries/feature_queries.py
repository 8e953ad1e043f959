"""Vocabularies, TF-IDF and character n-grams over the labelled documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from labelloom.operators import features as ft, weights as wt
from queries.common import (
    CORPUS_SQL,
    FOLDED_CORPUS_SQL,
    FOLDED_SQL,
    FOLDS,
    LABELS,
    TOKEN_SQL,
    bigints,
    corpus,
    folded_corpus,
    rounded,
    unlabelled,
)

SMALL_WORDS = replace(ft.WORD_TFIDF, max_features=2000, min_df=3, max_df=0.6)
SMALL_CHARS = replace(ft.CHAR_NGRAMS, max_features=3000, max_df=0.5)


def _terms(rows, representation):
    return ft.with_terms(rows.select("doc_id", "text"), "text", representation)


def _count(rows):
    return rows.agg(F.count(F.lit(1))).scalar()


def _vocabulary(rows, representation):
    folded = rows.select("doc_id", ft.folded_text("text", representation).alias("text"))
    counts = ft.text_term_counts(folded, "text", representation)
    return ft.vocabulary(
        counts, _count(rows), representation.min_df, representation.max_df, representation.max_features
    )


def _vocabulary_query(representation):
    def build(spark, sf):
        return bigints(_vocabulary(corpus(spark, sf), representation), "term_idx")

    return build


def _fold_vocabularies_query(representation):
    def build(spark, sf):
        rows = folded_corpus(spark, sf).select("doc_id", "text", "fold")
        terms = ft.with_terms(rows, "text", representation)
        return bigints(ft.fold_vocabularies(terms, representation, "fold", range(FOLDS)), "term_idx", "fold")

    return build


def tfidf(spark, sf):
    rows = corpus(spark, sf)
    vocab = ft.with_idf(_vocabulary(rows, ft.WORD_TFIDF), _count(rows))
    long = ft.tfidf(rows, vocab, "doc_id", "text", ft.WORD_TFIDF)
    return bigints(rounded(long, "value"), "term_idx")


def _binary_query(representation):
    def build(spark, sf):
        rows = corpus(spark, sf)
        long = ft.binary_ngrams(rows, _vocabulary(rows, representation), "doc_id", "text", representation)
        return bigints(rounded(long, "value"), "term_idx")

    return build


def _transform_query(representation):
    def build(spark, sf):
        rows = corpus(spark, sf)
        vocab = ft.with_idf(_vocabulary(rows, representation), _count(rows))
        long = ft.transform_with(unlabelled(spark, sf), vocab, "doc_id", "text", representation)
        return bigints(rounded(long, "value"), "term_idx")

    return build


def _vectors_query(representation):
    """The packed vectors, told by their size, entries and squared length."""

    def build(spark, sf):
        rows = corpus(spark, sf)
        vocab = ft.with_idf(_vocabulary(rows, representation), _count(rows))
        long = ft.transform_with(rows, vocab, "doc_id", "text", representation)
        vector = F.unwrap_udt("features")
        packed = ft.to_vectors(long, "doc_id", representation.max_features).select("doc_id", vector.alias("v"))
        square = F.aggregate("v.values", F.lit(0.0), lambda total, x: total + x * x)
        told = packed.select(
            "doc_id",
            F.size("v.indices").alias("entries"),
            F.try_element_at("v.indices", F.lit(1)).alias("first_index"),
            square.alias("squared_length"),
        )
        return bigints(rounded(told, "squared_length"), "entries", "first_index")

    return build


def _encode_query(representation):
    """The vector form of the features, told in the long form for comparison with it."""

    def build(spark, sf):
        rows = corpus(spark, sf)
        encoder = ft.fit_encoder(_vocabulary(rows, representation), representation, rows.count())
        vectors = ft.encode(_terms(rows, representation), encoder, ["doc_id"], DoubleType())
        entries = F.arrays_zip("indices", "values")
        long = vectors.select("doc_id", F.explode(entries).alias("e")).select(
            "doc_id", F.col("e.indices").cast("bigint").alias("term_idx"), F.col("e.values").cast("double").alias("value")
        )
        return rounded(long, "value")

    return build


def class_weights(spark, sf):
    return rounded(wt.class_weights(corpus(spark, sf), LABELS), "positive_weight", "negative_weight")


def row_weights(spark, sf):
    return rounded(wt.row_weights(corpus(spark, sf), LABELS).select("doc_id", "row_weight"), "row_weight")


def row_weights_capped(spark, sf):
    return rounded(wt.row_weights(corpus(spark, sf), LABELS, cap=1.5).select("doc_id", "row_weight"), "row_weight")


QUERIES = {
    "vocabulary": _vocabulary_query(ft.WORD_TFIDF),
    "vocabulary_capped": _vocabulary_query(SMALL_WORDS),
    "vocabulary_chars": _vocabulary_query(ft.CHAR_NGRAMS),
    "vocabulary_chars_capped": _vocabulary_query(SMALL_CHARS),
    "fold_vocabularies": _fold_vocabularies_query(ft.WORD_TFIDF),
    "fold_vocabularies_capped": _fold_vocabularies_query(SMALL_WORDS),
    "fold_vocabularies_chars": _fold_vocabularies_query(ft.CHAR_NGRAMS),
    "fold_vocabularies_chars_capped": _fold_vocabularies_query(SMALL_CHARS),
    "tfidf": tfidf,
    "binary_ngrams": _binary_query(ft.CHAR_NGRAMS),
    "binary_ngrams_capped": _binary_query(SMALL_CHARS),
    "transform_with": _transform_query(ft.WORD_TFIDF),
    "transform_with_capped": _transform_query(SMALL_WORDS),
    "transform_with_chars": _transform_query(ft.CHAR_NGRAMS),
    "to_vectors": _vectors_query(ft.WORD_TFIDF),
    "to_vectors_capped": _vectors_query(SMALL_WORDS),
    "encode": _encode_query(ft.WORD_TFIDF),
    "encode_capped": _encode_query(SMALL_WORDS),
    "class_weights": class_weights,
    "row_weights": row_weights,
    "row_weights_capped": row_weights_capped,
}


def _word_terms_sql(source, name, keep="doc_id"):
    """CTE: every word and word pair of every document."""
    return f"""{name} AS (
  SELECT {keep}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM (SELECT {keep}, regexp_extract_all({FOLDED_SQL.format(text="text")}, '{TOKEN_SQL}') AS t FROM {source}))"""


def _char_terms_sql(source, name, keep="doc_id"):
    """CTE: every distinct run of three to five characters of every document."""
    return rf"""{name} AS (
  SELECT {keep}, unnest(list_distinct(list_concat(list_concat(
    list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2]),
    list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3])),
    list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4])))) AS term
  FROM (SELECT {keep}, string_split(regexp_replace({FOLDED_SQL.format(text="text")}, '\s\s+', ' ', 'g'), '') AS c
        FROM {source}))"""


def _vocabulary_sql(r, terms, source, name):
    """CTE: the fitted vocabulary."""
    return f"""{name} AS (
  SELECT row_number() OVER (ORDER BY term) - 1 AS term_idx, term, tf, df FROM (
    SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM {terms} GROUP BY term
    HAVING count(DISTINCT doc_id) >= {r.min_df}
       AND count(DISTINCT doc_id) <= CAST({r.max_df} AS DOUBLE) * (SELECT count(*) FROM {source})
    ORDER BY tf DESC, term LIMIT {r.max_features}))"""


def _vocabulary_query_sql(r):
    terms = (_char_terms_sql if r.binary else _word_terms_sql)("corpus", "terms")
    return f"WITH {CORPUS_SQL}, {terms}, {_vocabulary_sql(r, 'terms', 'corpus', 'vocab')} SELECT * FROM vocab"


def _fold_vocabularies_sql(r):
    terms = (_char_terms_sql if r.binary else _word_terms_sql)("folded", "terms", keep="doc_id, fold")
    return f"""WITH {FOLDED_CORPUS_SQL}, {terms}, per_fold AS (
  SELECT f.fold, t.term, count(*) AS tf, count(DISTINCT t.doc_id) AS df
  FROM terms t, (SELECT unnest(range({FOLDS})) AS fold) f WHERE t.fold <> f.fold GROUP BY ALL),
sizes AS (SELECT f.fold, count(*) AS n FROM folded d, (SELECT unnest(range({FOLDS})) AS fold) f
          WHERE d.fold <> f.fold GROUP BY ALL),
placed AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.fold ORDER BY tf DESC, term) AS place
  FROM per_fold p JOIN sizes s ON p.fold = s.fold
  WHERE df >= {r.min_df} AND df <= CAST({r.max_df} AS DOUBLE) * s.n)
SELECT row_number() OVER (PARTITION BY fold ORDER BY term) - 1 AS term_idx, term, tf, df, CAST(fold AS BIGINT) AS fold
FROM placed WHERE place <= {r.max_features}"""


def _tfidf_sql(r, source, name):
    """CTE: TF-IDF of ``source`` on the vocabulary of the corpus."""
    return f"""{_word_terms_sql("corpus", "fit_terms")}, {_vocabulary_sql(r, "fit_terms", "corpus", "vocab")},
{_word_terms_sql(source, "new_terms")}, counted AS (
  SELECT doc_id, term, count(*) AS tf FROM new_terms GROUP BY ALL),
weighted AS (
  SELECT c.doc_id, v.term_idx, c.term, (1 + ln(CAST(c.tf AS DOUBLE)))
         * (ln(CAST(1 + (SELECT count(*) FROM corpus) AS DOUBLE) / CAST(1 + v.df AS DOUBLE)) + 1) AS w
  FROM counted c JOIN vocab v ON c.term = v.term),
{name} AS (
  SELECT doc_id, term_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM weighted)"""


UNLABELLED_SQL = "unlabelled AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"


def _row_weights_sql(cap):
    return f"""WITH {CORPUS_SQL}, n AS (
  SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(toxic) AS DOUBLE) AS t, CAST(sum(low_quality) AS DOUBLE) AS q FROM corpus),
raw AS (
  SELECT doc_id, (CASE WHEN toxic = 1 THEN n / (2 * t) ELSE n / (2 * (n - t)) END
                + CASE WHEN low_quality = 1 THEN n / (2 * q) ELSE n / (2 * (n - q)) END) / 2 AS w FROM corpus, n),
scaled AS (SELECT doc_id, least(w / avg(w) OVER (), CAST({cap} AS DOUBLE)) AS w FROM raw)
SELECT doc_id, round(w / avg(w) OVER (), 6) AS row_weight FROM scaled"""


def _binary_sql(r, source="corpus"):
    """Statement: the unit-length binary features of ``source`` on the vocabulary of the corpus, as CTE ``long``."""
    new = "" if source == "corpus" else _char_terms_sql(source, "new_terms") + ", "
    return f"""{_char_terms_sql("corpus", "terms")}, {_vocabulary_sql(r, "terms", "corpus", "vocab")}, {new}long AS (
  SELECT t.doc_id, v.term_idx, t.term, 1 / sqrt(CAST(count(*) OVER (PARTITION BY t.doc_id) AS DOUBLE)) AS value
  FROM {"new_terms" if new else "terms"} t JOIN vocab v ON t.term = v.term)"""


def _transform_sql(r):
    long = _binary_sql(r, "unlabelled") if r.binary else _tfidf_sql(r, "unlabelled", "long")
    return f"""WITH {CORPUS_SQL}, {UNLABELLED_SQL}, {long}
SELECT u.doc_id, l.term_idx, l.term, round(l.value, 6) AS value FROM unlabelled u LEFT JOIN long l ON u.doc_id = l.doc_id"""


def _vectors_sql(r):
    return f"""WITH {CORPUS_SQL}, {_tfidf_sql(r, "corpus", "long")}
SELECT c.doc_id, count(l.term_idx) AS entries, min(l.term_idx) AS first_index,
  round(coalesce(sum(l.value * l.value), 0), 6) AS squared_length
FROM corpus c LEFT JOIN long l ON c.doc_id = l.doc_id GROUP BY c.doc_id"""


def _encode_sql(r):
    return f"""WITH {CORPUS_SQL}, {_tfidf_sql(r, "corpus", "long")} SELECT doc_id, term_idx, round(value, 6) AS value FROM long"""


BINARY_SQL = "WITH {corpus}, {long} SELECT doc_id, term_idx, term, round(value, 6) AS value FROM long"

ORACLES = {
    "vocabulary": _vocabulary_query_sql(ft.WORD_TFIDF),
    "vocabulary_capped": _vocabulary_query_sql(SMALL_WORDS),
    "vocabulary_chars": _vocabulary_query_sql(ft.CHAR_NGRAMS),
    "vocabulary_chars_capped": _vocabulary_query_sql(SMALL_CHARS),
    "fold_vocabularies": _fold_vocabularies_sql(ft.WORD_TFIDF),
    "fold_vocabularies_capped": _fold_vocabularies_sql(SMALL_WORDS),
    "fold_vocabularies_chars": _fold_vocabularies_sql(ft.CHAR_NGRAMS),
    "fold_vocabularies_chars_capped": _fold_vocabularies_sql(SMALL_CHARS),
    "tfidf": f"""WITH {CORPUS_SQL}, {_tfidf_sql(ft.WORD_TFIDF, "corpus", "long")}
SELECT doc_id, term_idx, term, round(value, 6) AS value FROM long""",
    "binary_ngrams": BINARY_SQL.format(corpus=CORPUS_SQL, long=_binary_sql(ft.CHAR_NGRAMS)),
    "binary_ngrams_capped": BINARY_SQL.format(corpus=CORPUS_SQL, long=_binary_sql(SMALL_CHARS)),
    "transform_with": _transform_sql(ft.WORD_TFIDF),
    "transform_with_capped": _transform_sql(SMALL_WORDS),
    "transform_with_chars": _transform_sql(ft.CHAR_NGRAMS),
    "to_vectors": _vectors_sql(ft.WORD_TFIDF),
    "to_vectors_capped": _vectors_sql(SMALL_WORDS),
    "encode": _encode_sql(ft.WORD_TFIDF),
    "encode_capped": _encode_sql(SMALL_WORDS),
    "class_weights": f"""WITH {CORPUS_SQL}, cells AS (
  SELECT 'toxic' AS label, toxic AS y FROM corpus UNION ALL SELECT 'low_quality', low_quality FROM corpus)
SELECT label, round(CAST(count(*) AS DOUBLE) / CAST(2 * sum(y) AS DOUBLE), 6) AS positive_weight,
  round(CAST(count(*) AS DOUBLE) / CAST(2 * sum(1 - y) AS DOUBLE), 6) AS negative_weight FROM cells GROUP BY label""",
    "row_weights": _row_weights_sql(8.0),
    "row_weights_capped": _row_weights_sql(1.5),
}
