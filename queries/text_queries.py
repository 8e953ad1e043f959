"""Text functions over every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as tx
from queries.common import FOLDED_SQL, SENTENCES_SQL, TOKEN_SQL, bigints, documents

FOLDED = FOLDED_SQL.format(text="text")
TOKENS = f"regexp_extract_all(text, '{TOKEN_SQL}')"
FOLDED_TOKENS = f"regexp_extract_all({FOLDED}, '{TOKEN_SQL}')"


def _documents(spark, sf):
    return documents(spark, sf).select("doc_id", "text")


def _digest(column):
    return F.md5(F.array_join(column, "|"))


def canonical_text(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.canonical_text("text").alias("canonical"))


def tokens(spark, sf):
    words = _documents(spark, sf).select("doc_id", tx.tokens("text").alias("words"))
    return bigints(
        words.select("doc_id", F.size("words").alias("tokens"), _digest("words").alias("digest")), "tokens"
    )


def token_count(spark, sf):
    return bigints(_documents(spark, sf).select("doc_id", tx.token_count("text").alias("tokens")), "tokens")


def sentence_like_count(spark, sf):
    return bigints(
        _documents(spark, sf).select("doc_id", tx.sentence_like_count("text").alias("sentences")), "sentences"
    )


def fold_accents(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(tx.fold_accents("text")).alias("digest"))


def _folded(spark, sf):
    return _documents(spark, sf).select("doc_id", tx.fold_accents("text").alias("folded"))


def word_tokens_min2(spark, sf):
    words = _folded(spark, sf).select("doc_id", tx.word_tokens_min2("folded").alias("words"))
    return bigints(words.select("doc_id", F.size("words").alias("tokens"), _digest("words").alias("digest")), "tokens")


def remove_stop_words(spark, sf):
    words = _folded(spark, sf).select(
        "doc_id", tx.remove_stop_words(tx.word_tokens_min2("folded")).alias("words")
    )
    return bigints(words.select("doc_id", F.size("words").alias("tokens"), _digest("words").alias("digest")), "tokens")


def word_ngrams(spark, sf):
    words = _folded(spark, sf).select("doc_id", tx.tokens("folded").alias("words"))
    grams = words.select("doc_id", tx.word_ngrams("words").alias("grams"))
    return bigints(grams.select("doc_id", F.size("grams").alias("terms"), _digest("grams").alias("digest")), "terms")


def char_ngrams(spark, sf):
    grams = _folded(spark, sf).select("doc_id", tx.char_ngrams("folded").alias("grams"))
    return bigints(
        grams.select(
            "doc_id",
            F.size("grams").alias("occurrences"),
            F.size(F.array_distinct("grams")).alias("distinct_terms"),
        ),
        "occurrences",
        "distinct_terms",
    )


STOP_LIST = ", ".join(f"'{word}'" for word in tx.STOP_WORDS)
MIN2 = f"list_filter({FOLDED_TOKENS}, lambda w: length(w) >= 2)"
WITHOUT_STOPS = f"list_filter({MIN2}, lambda w: w NOT IN ({STOP_LIST}))"
SPACED = rf"regexp_replace({FOLDED}, '\s\s+', ' ', 'g')"


def _list_sql(expression, count):
    return f"""SELECT doc_id, CAST(len(words) AS BIGINT) AS {count},
  md5(array_to_string(words, '|')) AS digest FROM (SELECT doc_id, {expression} AS words FROM documents)"""


QUERIES = {
    "canonical_text": canonical_text,
    "tokens": tokens,
    "token_count": token_count,
    "sentence_like_count": sentence_like_count,
    "fold_accents": fold_accents,
    "word_tokens_min2": word_tokens_min2,
    "remove_stop_words": remove_stop_words,
    "word_ngrams": word_ngrams,
    "char_ngrams": char_ngrams,
}
ORACLES = {
    "tokens": _list_sql(TOKENS, "tokens"),
    "token_count": f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS tokens FROM documents",
    "sentence_like_count": "SELECT doc_id, CAST("
    + SENTENCES_SQL.format(text="text")
    + " AS BIGINT) AS sentences FROM documents",
    "fold_accents": f"SELECT doc_id, md5({FOLDED}) AS digest FROM documents",
    "word_tokens_min2": _list_sql(MIN2, "tokens"),
    "remove_stop_words": _list_sql(WITHOUT_STOPS, "tokens"),
    "word_ngrams": f"""SELECT doc_id, CAST(len(words) AS BIGINT) AS terms, md5(array_to_string(words, '|')) AS digest
FROM (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS words
      FROM (SELECT doc_id, {FOLDED_TOKENS} AS t FROM documents))""",
    "char_ngrams": f"""WITH chars AS (
  SELECT doc_id, string_split({SPACED}, '') AS c FROM documents),
grams AS (
  SELECT doc_id, list_concat(list_concat(
    list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2]),
    list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3])),
    list_transform(range(1, len(c) - 3), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4])) AS g
  FROM chars)
SELECT doc_id, CAST(len(g) AS BIGINT) AS occurrences,
  CAST(len(list_distinct(g)) AS BIGINT) AS distinct_terms FROM grams""",
}
