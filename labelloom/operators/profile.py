"""Class, length and word profile of a labelled corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.text import (
    fold_accents,
    remove_stop_words,
    sentence_like_count,
    token_count,
    word_tokens_min2,
)
from labelloom.staging import stage

CLEAN = "clean"


def positive_classes(label_cols: Sequence[str]) -> Column:
    """Array of the labels a row carries, or ``clean`` when it carries none."""
    named = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in label_cols]))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(CLEAN)))


def class_membership(df: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """One row per row and class; classes overlap."""
    return df.withColumn("class", F.explode(positive_classes(label_cols)))


def class_summary(df: DataFrame, text_col: str, label_cols: Sequence[str]) -> DataFrame:
    """Per class: comments, prevalence, sentence-like units, tokens, means and exact median tokens.

    Counts are taken before a row is repeated per class, so each text is scanned once. The median
    merges histograms of token counts, which combine before the shuffle.
    """
    counted = df.select(
        token_count(text_col).alias("tokens"),
        sentence_like_count(text_col).alias("sentences"),
        positive_classes(label_cols).alias("classes"),
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        counted.select("tokens", "sentences", F.explode("classes").alias("class"))
        .groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("comment_count"),
            F.sum("sentences").alias("sentence_like_units"),
            F.sum("tokens").alias("token_total"),
            F.avg("sentences").alias("mean_sentence_like_units_per_comment"),
            F.avg("tokens").alias("mean_tokens_per_comment"),
            F.median("tokens").alias("median_tokens_per_comment"),
        )
        .withColumnRenamed("token_total", "tokens")
        .withColumn("comment_prevalence", F.col("comment_count") / total)
    )


def corpus_totals(df: DataFrame, text_col: str) -> DataFrame:
    """Comments, tokens and sentence-like units of the whole corpus."""
    return df.agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.coalesce(F.sum(token_count(text_col)), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(sentence_like_count(text_col)), F.lit(0)).alias("total_sentence_like_units"),
    )


def top_words_by_class(
    df: DataFrame,
    text_col: str,
    label_cols: Sequence[str],
    k: int = 15,
    min_df: int = 2,
    vocabulary_limit: int = 60_000,
) -> DataFrame:
    """The ``k`` most frequent words of every class, over one shared vocabulary.

    One aggregation by word carries a column per class, so tokens are shuffled once (combined
    first) and not once per class. A document's repeats are recognised by their neighbour in the
    sorted token array, which spares the shuffle a distinct count would need.
    """
    classes = [*label_cols, CLEAN]
    member = [F.array_contains("classes", c).cast("int") for c in classes]
    words = df.select(
        F.sort_array(remove_stop_words(word_tokens_min2(fold_accents(text_col)))).alias("words"),
        positive_classes(label_cols).alias("classes"),
    ).select("words", *[m.alias(f"in_{c}") for m, c in zip(member, classes)])
    each = exploded(words, "words", "word")
    fresh = (F.col("pos") == 0) | (F.col("word") != F.get("words", F.col("pos") - 1))
    per_word = each.select("word", fresh.cast("int").alias("fresh"), *[f"in_{c}" for c in classes]).groupBy("word").agg(
        F.sum("fresh").alias("df"),
        F.count(F.lit(1)).alias("tf"),
        *[F.sum(f"in_{c}").alias(f"n_{c}") for c in classes],
    )
    kept = most_frequent(per_word.where(F.col("df") >= min_df), "tf", "word", vocabulary_limit)
    cells = F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(f"n_{c}").alias("frequency")) for c in classes]
    )
    # At most vocabulary_limit rows per class reach a window.
    order = Window.partitionBy("class").orderBy(F.desc("frequency"), F.desc("word"))
    return (
        kept.select("word", F.inline(cells))
        .where(F.col("frequency") > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("class", "rank", "word", "frequency")
    )


def exploded(df: DataFrame, array_col: str, out: str) -> DataFrame:
    """Add ``pos`` and one row per array element.

    An inner explode makes the optimizer filter on the array's size where the table is read, which
    computes the array a second time; an outer one followed by a filter on its output does not.
    """
    rows = df.select("*", F.posexplode_outer(array_col).alias("pos", out))
    return rows.where(F.col(out).isNotNull())


#: Splitters of a selection round, and rows that end the rounds.
SPLITTERS, FEW = 256, 10_000


def nth_smallest(rows: DataFrame, key: str, n: int) -> object:
    """The ``n``-th smallest (from 1) of the distinct values of ``key``, without ever ordering many of them.

    Each round draws splitters by hash, counts the rows between them and goes on between the two that enclose the value, so a round
    leaves about one in ``SPLITTERS`` rows.
    """
    low = high = None
    while True:
        between = rows
        between = between if low is None else between.where(F.col(key) > F.lit(low))
        between = between if high is None else between.where(F.col(key) <= F.lit(high))
        drawn = between.select(key).orderBy(F.xxhash64(key)).limit(SPLITTERS).collect()
        ends = sorted(row[0] for row in drawn)
        if len(ends) < SPLITTERS:
            return ends[n - 1]
        place = F.array_size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col(key)))
        counts = {row["place"]: row["count"] for row in between.groupBy(place.alias("place")).count().collect()}
        for at in range(len(ends) + 1):
            if n <= counts.get(at, 0):
                break
            n -= counts.get(at, 0)
        low, high = ends[at - 1] if at else low, ends[at] if at < len(ends) else high
        if counts[at] <= FEW:
            last = rows.where(F.col(key) <= F.lit(high)) if high is not None else rows
            last = last.where(F.col(key) > F.lit(low)) if low is not None else last
            return sorted(row[0] for row in last.select(key).collect())[n - 1]


def most_frequent(terms: DataFrame, count: str, tie: str, limit: int, written: bool = False) -> DataFrame:
    """The ``limit`` terms with the highest count, ties broken by the term; in no order.

    The counts are written once, as several passes read them, unless they are ``written`` already. A histogram of the counts (few
    distinct values) gives the lowest count still needed, and a selection among the terms at that count the last term needed.
    """
    terms = terms if written else stage(terms, "terms")
    alone = Window.partitionBy(F.lit(0)).orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    steps = terms.groupBy(count).agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(alone), F.lit(0)))
    last = steps.where(F.col("_above") < limit).agg(F.min_by(F.struct(count, "_above", "_n"), count)).first()[0]
    if last is None or last["_above"] + last["_n"] <= limit:
        return terms if last is None else terms.where(F.col(count) >= last[count])
    tied = terms.where(F.col(count) == last[count])
    end = nth_smallest(tied, tie, limit - last["_above"])
    return terms.where((F.col(count) > last[count]) | ((F.col(count) == last[count]) & (F.col(tie) <= F.lit(end))))
