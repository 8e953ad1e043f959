"""Word TF-IDF and binary character n-grams.

Two forms of the same features: the long form, one row per document and term, and the vector form, which feeds the model
fits. A vocabulary of at most ``BROADCAST_ROWS`` terms is sent to the documents and each is encoded where it lies, without a
shuffle; for a larger one the long form is joins and aggregates.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelloom.functions import ngrams
from labelloom.functions.text import char_ngrams, fold_accents, single_spaces, tokens, word_ngrams
from labelloom.operators.profile import exploded, most_frequent
from labelloom.operators.ranking import BROADCAST_ROWS
from labelloom.operators.vectors import alike_in_rows, full_block, short_indices
from labelloom.staging import stage

#: Documents whose terms are looked up at once, and about the most characters of texts whose n-grams are counted at once.
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20
#: Texts whose n-grams are looked up at once: they have thousands each.
TEXTS_AT_ONCE = 64


@dataclass(frozen=True)
class Representation:
    """How an accent-folded text becomes terms, and how its terms are weighted and pruned.

    ``lengths`` says that the terms are all character n-grams of these lengths, from the least to the greatest. The fits find, count and
    encode those as numbers, as far as they are binary.
    """

    name: str
    terms: Callable[[str], Column]
    binary: bool
    max_features: int
    min_df: int = 2
    max_df: float = 0.995
    lengths: tuple[int, int] | None = None


def word_terms(folded: str) -> Column:
    return word_ngrams(tokens(folded))


def char_terms(folded: str) -> Column:
    return char_ngrams(folded)


WORD_TFIDF = Representation("word_tfidf", word_terms, binary=False, max_features=250_000)
CHAR_NGRAMS = Representation("character_bag_of_ngrams", char_terms, binary=True, max_features=300_000, lengths=(3, 5))
REPRESENTATIONS = (WORD_TFIDF, CHAR_NGRAMS)


def with_terms(df: DataFrame, text_col: str, representation: Representation) -> DataFrame:
    """Replace the text by its ``terms``, sorted; each once if the representation is binary."""
    return _terms_of_folded(df.withColumn(text_col, fold_accents(text_col)), text_col, representation)


def _terms_of_folded(folded: DataFrame, text_col: str, representation: Representation) -> DataFrame:
    terms = representation.terms(text_col)
    terms = F.array_distinct(terms) if representation.binary else F.sort_array(terms)
    return folded.withColumn("terms", terms).drop(text_col)


def term_counts(
    df: DataFrame, binary: bool, fold_col: str | None = None, folds: Sequence[int] = ()
) -> DataFrame:
    """Per term ``tf`` and ``df``, and the same within each fold as ``tf_<fold>``, ``df_<fold>``.

    One shuffle, on the term, after combining on the map side. A repeat within a document is
    recognised by its neighbour in the sorted array.
    """
    fold = [F.col(fold_col).alias("fold")] if fold_col else []
    each = exploded(df.select(*fold, "terms"), "terms", "term")
    if binary:
        fresh = F.lit(1)
    else:
        fresh = ((F.col("pos") == 0) | (F.col("term") != F.get("terms", F.col("pos") - 1))).cast("int")
    each = each.select("term", fresh.alias("fresh"), *[F.col("fold") for _ in fold])
    measures = [F.count(F.lit(1)).alias("tf"), F.sum("fresh").alias("df")]
    for f in folds:
        here = F.col("fold") == f
        measures += [
            F.count(F.when(here, 1)).alias(f"tf_{f}"),
            F.coalesce(F.sum(F.when(here, F.col("fresh"))), F.lit(0)).alias(f"df_{f}"),
        ]
    return each.groupBy("term").agg(*measures)


def folded_text(text_col: str, representation: Representation) -> Column:
    """Texts as ``text_term_counts`` and ``encode_text`` take them."""
    folded = fold_accents(text_col)
    return single_spaces(folded) if representation.lengths else folded


def text_term_counts(
    df: DataFrame, text_col: str, representation: Representation, fold_col: str | None = None, folds: Sequence[int] = ()
) -> DataFrame:
    """``term_counts`` of folded texts. Character n-grams become strings only once for about a million characters, not once per text."""
    if not (representation.binary and representation.lengths):
        return term_counts(_terms_of_folded(df, text_col, representation), representation.binary, fold_col, folds)
    low, high = representation.lengths
    fold = [F.col(fold_col).alias("fold")] if fold_col else []
    folded = df.select(*fold, F.col(text_col).alias("text")).where("text IS NOT NULL")
    schema = T.StructType(
        [*folded.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())]
    )

    def counted(texts: dict[tuple, list[str]]) -> Iterator[pa.RecordBatch]:
        for of_fold, some in texts.items():
            for terms, counts in ngrams.document_counts(some, low, high):
                same = [pa.array([value] * len(terms), kind) for value, kind in zip(of_fold, kinds)]
                yield pa.RecordBatch.from_arrays([*same, terms, pa.array(counts)], schema.names)

    kinds = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[str]] = {}
        chars = 0
        for batch in batches:
            for row in range(batch.num_rows):
                *of_fold, text = (column[row].as_py() for column in batch.columns)
                held.setdefault(tuple(of_fold), []).append(text)
                chars += len(text)
                if chars >= CHARS_AT_ONCE:
                    yield from counted(held)
                    held, chars = {}, 0
        yield from counted(held)

    measures = [F.sum("n").alias("tf"), F.sum("n").alias("df")]
    for f in folds:
        here = F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0))
        measures += [here.alias(f"tf_{f}"), here.alias(f"df_{f}")]
    return folded.mapInArrow(run, schema).groupBy("term").agg(*measures)


def vocabulary(
    counts: DataFrame, rows: Column | int, min_df: int, max_df: float, max_features: int, written: bool = False
) -> DataFrame:
    """Terms within the document-frequency limits, the most frequent ones if too many, numbered
    alphabetically from 0 as ``term_idx``. At most ``max_features`` rows. Counts that are ``written`` are not written again."""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    within = counts.where((F.col("df") >= min_df) & (F.col("df") <= rows * F.lit(float(max_df))))
    kept = most_frequent(within.select("term", "tf", "df"), "tf", "term", max_features, written)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1
    return kept.select(position.alias("term_idx"), "term", "tf", "df")


def training_counts(counts: DataFrame, fold: int) -> DataFrame:
    """Term counts of all rows outside a fold: the total less the fold's own."""
    return counts.select(
        "term",
        (F.col("tf") - F.col(f"tf_{fold}")).alias("tf"),
        (F.col("df") - F.col(f"df_{fold}")).alias("df"),
    ).where("df > 0")


def fold_term_counts(
    df: DataFrame, representation: Representation, fold_col: str, folds: Sequence[int], text_col: str | None = None
) -> DataFrame:
    """Term counts with every fold's share, written once for the vocabularies of all folds; of ``terms``, or of a column of folded texts.

    A term too rare in the whole table is too rare in any part of it and is left out.
    """
    if text_col:
        counts = text_term_counts(df, text_col, representation, fold_col, folds)
    else:
        counts = term_counts(df, representation.binary, fold_col, folds)
    return stage(counts.where(F.col("df") >= representation.min_df), "fold_term_counts")


def fold_vocabularies(
    df: DataFrame, representation: Representation, fold_col: str, folds: Sequence[int]
) -> DataFrame:
    """One vocabulary per fold, fitted on the rows of the other folds, from one pass over the terms."""
    counts = fold_term_counts(df, representation, fold_col, folds)
    sizes = {row[0]: row["count"] for row in df.groupBy(fold_col).count().collect()}
    fitted = None
    for f in folds:
        one = vocabulary(
            training_counts(counts, f), sum(sizes.values()) - sizes.get(f, 0), representation.min_df, representation.max_df,
            representation.max_features, written=True,
        ).withColumn("fold", F.lit(f))
        fitted = one if fitted is None else fitted.unionByName(one)
    return fitted


def with_idf(vocab: DataFrame, rows: Column | int) -> DataFrame:
    """Smoothed inverse document frequency ``ln((1+n)/(1+df)) + 1``."""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    return vocab.withColumn("idf", F.log((1 + rows) / (1 + F.col("df"))) + 1)


def _unit_length(weighted: DataFrame, id_col: str) -> DataFrame:
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(id_col)))
    return weighted.withColumn("value", F.col("value") / length)


def _terms_by_id(df: DataFrame, id_col: str, text_col: str, representation: Representation) -> DataFrame:
    """One row per document and term occurrence, all of a document in one partition.

    The texts are shuffled by id before their terms are made, so that neither the term count nor
    the length needs a shuffle of the many times larger terms. Accents are folded before, because
    Spark forgets the partitioning of what passes through Python.
    """
    placed = df.select(id_col, fold_accents(text_col).alias(text_col)).repartition(id_col)
    return exploded(_terms_of_folded(placed, text_col, representation), "terms", "term").select(id_col, "term")


def _joined(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, representation: Representation) -> DataFrame:
    """The long form by a join on the term, for a vocabulary of any size."""
    terms = _terms_by_id(df, id_col, text_col, representation)
    if representation.binary:
        weighted = terms.join(vocab.select("term", "term_idx"), "term").withColumn("value", F.lit(1.0))
    else:
        counts = terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
        weight = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
        weighted = counts.join(vocab.select("term", "term_idx", "idf"), "term").withColumn("value", weight)
    return _unit_length(weighted.select(id_col, "term_idx", "term", "value"), id_col)


def _looked_up(
    df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, representation: Representation, empty: bool
) -> DataFrame:
    """The long form by looking every document's terms up where it lies: no term is shuffled, none is exploded as a string.

    ``vocab`` has at most ``BROADCAST_ROWS`` rows. With ``empty`` a document without a known term keeps a line of nulls.
    """
    encoder = fit_encoder(vocab, representation)
    grams = ngrams.Vocabulary.of(encoder.terms, *representation.lengths) if representation.binary and representation.lengths else None
    shared = df.sparkSession.sparkContext.broadcast((encoder.terms, encoder.idf, grams))
    schema = T.StructType(
        [df.schema[id_col], T.StructField("term_idx", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("value", T.DoubleType())]
    )
    at_once = ROWS_AT_ONCE if grams is None else TEXTS_AT_ONCE
    made = with_terms(df.select(id_col, text_col), text_col, representation) if grams is None else df.select(
        id_col, folded_text(text_col, representation).alias("terms")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, grams = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                some = batch.slice(start, at_once)
                found = encode_rows(some.column("terms"), terms, idf) if grams is None else grams.encode(some.column("terms").to_pylist())
                ends, index, values = found
                row = np.repeat(np.arange(some.num_rows), np.diff(ends))
                if empty:
                    bare = np.flatnonzero(np.diff(ends) == 0)
                    row, index, values = (np.concatenate([a, b]) for a, b in ((row, bare), (index, np.full(len(bare), -1)), (values, np.zeros(len(bare)))))
                index = pa.array(index, pa.int32(), mask=index < 0)
                yield pa.RecordBatch.from_arrays(
                    [some.column(id_col).take(pa.array(row)), index, terms.take(index), pa.array(values, mask=~pc.is_valid(index).to_numpy(zero_copy_only=False))],
                    schema.names,
                )

    return made.mapInArrow(run, schema)


def _long_form(df, vocab, id_col, text_col, representation, empty: bool) -> DataFrame:
    if representation.max_features <= BROADCAST_ROWS:
        return _looked_up(df, vocab, id_col, text_col, representation, empty)
    long = _joined(df, vocab, id_col, text_col, representation)
    return df.select(id_col).join(long, id_col, "left") if empty else long


def tfidf(
    df: DataFrame, vocab_idf: DataFrame, id_col: str, text_col: str, representation: Representation
) -> DataFrame:
    """Long ``(id, term_idx, term, value)``: ``(1+ln tf)*idf``, each document of unit length.

    The vocabulary holds at most ``max_features`` rows; if that is few it is sent to the documents, else joined.
    """
    return _long_form(df, vocab_idf, id_col, text_col, representation, empty=False)


def binary_ngrams(
    df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, representation: Representation
) -> DataFrame:
    """Long ``(id, term_idx, term, value)``: every present term alike, each document of unit length."""
    return _long_form(df, vocab, id_col, text_col, representation, empty=False)


def transform_with(
    df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, representation: Representation
) -> DataFrame:
    """Features of unseen rows on a fitted vocabulary, all rows kept.

    Terms outside the vocabulary are dropped; a row without a known term keeps one line whose
    term and value are null: the zero vector.
    """
    return _long_form(df, vocab, id_col, text_col, representation, empty=True)


def to_vectors(long: DataFrame, id_col: str, size: int) -> DataFrame:
    """Pack the long form into one ML sparse vector per row (at most ``size`` entries each)."""

    @F.pandas_udf(VectorUDT())
    def sparse(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        # The fields of the vector type; type 0 is sparse. The arrays pass through as they are.
        return pd.DataFrame({"type": np.int8(0), "size": np.int32(size), "indices": indices, "values": values})

    entries = F.filter(
        F.sort_array(F.collect_list(F.struct("term_idx", "value"))), lambda e: e["term_idx"].isNotNull()
    )
    packed = long.groupBy(id_col).agg(entries.alias("entries"))
    return packed.select(id_col, sparse(F.col("entries.term_idx"), F.col("entries.value")).alias("features"))


@dataclass(frozen=True)
class Encoder:
    """A fitted vocabulary on the driver: at most ``max_features`` terms, in index order."""

    terms: pa.Array
    idf: np.ndarray | None

    @property
    def size(self) -> int:
        return len(self.terms)


def fit_encoder(vocab: DataFrame, representation: Representation, rows: int | None = None) -> Encoder:
    """Collect a vocabulary and its idf, which follows from the number of rows unless the vocabulary has it. Vocabularies too
    large to send to every task belong in the long form instead."""
    if representation.max_features > BROADCAST_ROWS:
        raise ValueError(f"An encoder takes at most {BROADCAST_ROWS} terms; use transform_with and to_vectors.")
    weight = [] if representation.binary else ["idf" if rows is None else "df"]
    table = vocab.select("term_idx", "term", *weight).toArrow().sort_by("term_idx")
    if table.num_rows == 0:
        raise ValueError("No terms remain within the document-frequency limits.")
    idf = None
    if not representation.binary:
        idf = table["idf"].to_numpy() if rows is None else np.log((1.0 + rows) / (1.0 + table["df"].to_numpy())) + 1.0
    return Encoder(table["term"].combine_chunks(), idf)


def encode_rows(
    term_lists: pa.ListArray, terms: pa.Array, idf: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, term indices and unit-length weights of a batch of term lists."""
    offsets = term_lists.offsets.to_numpy()
    words = term_lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    index = pc.index_in(words, value_set=terms)
    known = pc.is_valid(index).to_numpy(zero_copy_only=False)
    index = index.fill_null(0).to_numpy().astype(np.int64)[known]
    row = np.repeat(np.arange(len(term_lists)), np.diff(offsets))[known]
    cells, counts = np.unique(row * len(terms) + index, return_counts=True)
    row, index = cells // len(terms), cells % len(terms)
    if idf is None:
        values = np.ones(len(cells))
    else:
        values = (1.0 + np.log(counts)) * idf[index]
    lengths = np.sqrt(np.bincount(row, weights=values * values, minlength=len(term_lists)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(term_lists)))])
    return ends, index, values / lengths[row]


def encode(
    df: DataFrame, encoder: Encoder, keep: Sequence[str], value_type: T.DataType = T.FloatType()
) -> DataFrame:
    """Rows with ``indices`` and ``values`` of their features, and the ``keep`` columns.

    Runs where the rows are: the only thing sent is the bounded vocabulary.
    """
    return _EncodedRows.of(df, "terms", (encoder.terms, encoder.idf), lambda terms, sent: encode_rows(terms, *sent), keep, value_type).rows()


def encode_text(
    df: DataFrame, text_col: str, representation: Representation, encoder: Encoder, keep: Sequence[str], unmade: bool = False
) -> DataFrame | _EncodedRows:
    """``encode`` of folded texts. Character n-grams are looked up as numbers, unless the vocabulary has more characters than those can
    tell. ``unmade`` rows are made where they are read: by one linear fit or its scores, or to be packed."""
    grams = ngrams.Vocabulary.of(encoder.terms, *representation.lengths) if representation.binary and representation.lengths else None
    if grams is None:
        terms, sent = _terms_of_folded(df, text_col, representation), (encoder.terms, encoder.idf)
        rows = _EncodedRows.of(terms, "terms", sent, lambda terms, sent: encode_rows(terms, *sent), keep, T.FloatType())
    else:
        rows = _EncodedRows.of(df, text_col, grams, lambda texts, sent: sent.encode(texts.to_pylist()), keep, T.FloatType())
    return rows if unmade else rows.rows()


@dataclass(frozen=True)
class _EncodedRows:
    """Rows of a table with the row offsets, indices and values that ``find`` makes of some rows of a column and of what is sent.

    Made and read in one task by ``mapInArrow``, the many entries of a row need not pass through Spark's own rows.
    """

    table: DataFrame
    column: str
    sent: object
    find: Callable
    schema: T.StructType

    @classmethod
    def of(cls, df: DataFrame, column: str, sent: object, find: Callable, keep: Sequence[str], value_type: T.DataType) -> _EncodedRows:
        made = [
            T.StructField("indices", T.ArrayType(T.IntegerType(), False), False),
            T.StructField("values", T.ArrayType(value_type, False), False),
        ]
        shared = df.sparkSession.sparkContext.broadcast(sent)
        return cls(df.select(*keep, F.col(column).alias("_made_of")), "_made_of", shared, find, T.StructType([df.schema[c] for c in keep] + made))

    @property
    def sparkSession(self):
        return self.table.sparkSession

    def count(self) -> int:
        return self.table.count()

    def select(self, *names: str) -> _EncodedRows:
        kept = [c for c in names if c not in ("indices", "values")]
        return _EncodedRows(self.table.select(*kept, self.column), self.column, self.sent, self.find, T.StructType([self.schema[c] for c in names]))

    def coalesce(self, parts: int) -> _EncodedRows:
        return _EncodedRows(self.table.coalesce(parts), self.column, self.sent, self.find, self.schema)

    def rows(self) -> DataFrame:
        return self.mapInArrow(iter, self.schema)

    def mapInArrow(self, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
        names, column, shared, find = self.schema.names, self.column, self.sent, self.find
        dtype = np.float32 if self.schema["values"].dataType.elementType == T.FloatType() else np.float64
        at_once = TEXTS_AT_ONCE if isinstance(self.table.schema[column].dataType, T.StringType) else ROWS_AT_ONCE

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, at_once):
                    some = batch.slice(start, at_once)
                    ends, index, values = find(some.column(column), shared.value)
                    ends = pa.array(ends.astype(np.int32))
                    made = {
                        "indices": pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32))),
                        "values": pa.ListArray.from_arrays(ends, pa.array(values.astype(dtype))),
                    }
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else some.column(c) for c in names], names)

        return self.table.mapInArrow(lambda batches: read(make(batches)), schema)

    def packed(self, apart: str | None = None) -> _PackedRows:
        """The rows as packed batches, to be kept and read many times; with ``apart`` a batch has one value of that column."""
        names = [c for c in self.schema.names if c not in ("indices", "values")]
        split = [T.StructField("apart", self.schema[apart].dataType)] if apart else []

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for value in whole.column(apart).unique() if apart else [None]:
                    batch = whole.filter(pc.equal(whole.column(apart), value)) if apart else whole
                    if not batch.num_rows:
                        continue
                    indices, values = batch.column("indices"), batch.column("values").flatten().to_numpy()
                    lengths = indices.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
                    held = pa.BufferOutputStream()
                    with pa.ipc.new_stream(held, batch.select(names).schema) as writer:
                        writer.write_batch(batch.select(names))
                    arrays = *short_indices(indices.flatten().to_numpy(), lengths), alike_in_rows(values, lengths), None
                    data = pickle.dumps((held.getvalue().to_pybytes(), arrays), protocol=5)
                    made = {"apart": value, "n": batch.num_rows, "rows": data}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([made[c]], kind) for c, kind in zip(schema.names, kinds)], schema.names
                    )

        schema = T.StructType([*split, T.StructField("n", T.LongType()), T.StructField("rows", T.BinaryType())])
        kinds = [*([pa.int32() if isinstance(split[0].dataType, T.IntegerType) else pa.int64()] if apart else []), pa.int64(), pa.binary()]
        return _PackedRows(self.mapInArrow(pack, schema), self.schema)


@dataclass(frozen=True)
class _PackedRows:
    """Encoded rows as packed batches: indices of 16 bits, and a value for each row if those of a row are all the same.

    A table of them is a fraction of the arrays in Spark's own rows, to which the entries never have to be converted.
    """

    table: DataFrame
    schema: T.StructType

    @property
    def sparkSession(self):
        return self.table.sparkSession

    @property
    def storageLevel(self) -> StorageLevel:
        return self.table.storageLevel

    def persist(self, level: StorageLevel) -> _PackedRows:
        self.table.persist(level)
        return self

    def unpersist(self) -> None:
        self.table.unpersist()

    def count(self) -> int:
        return self.table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def where(self, condition: Column) -> _PackedRows:
        """Batches by the value that theirs have ``apart``."""
        return _PackedRows(self.table.where(condition), self.schema)

    def select(self, *names: str) -> _PackedRows:
        return _PackedRows(self.table, T.StructType([self.schema[c] for c in names]))

    def coalesce(self, parts: int) -> _PackedRows:
        return _PackedRows(self.table.coalesce(parts), self.schema)

    def rows(self) -> DataFrame:
        return self.mapInArrow(iter, self.schema)

    def mapInArrow(self, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
        names = self.schema.names

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("rows"):
                    held, arrays = pickle.loads(data.as_buffer())
                    some = pa.ipc.open_stream(held).read_next_batch()
                    lengths, index, values, _ = full_block(arrays)
                    values = np.repeat(values[:, 0], lengths) if values.ndim == 2 else values
                    ends = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
                    made = {
                        "indices": pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32))),
                        "values": pa.ListArray.from_arrays(ends, pa.array(values)),
                    }
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else some.column(c) for c in names], names)

        return self.table.select("rows").mapInArrow(lambda batches: read(unpack(batches)), schema)
