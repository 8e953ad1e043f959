"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Null and repeated rows, empty and very long texts and empty tables go through every stage as its operator states;
``documents`` may have further columns, which pass through up to the packing.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

import labelloom
from labelloom.llm import langid, mixing, packing, pii, simhash
from labelloom.llm.common import packed, unpacked
from labelloom.staging import scratch, stage

cloudpickle.register_pickle_by_value(labelloom)

#: Rows and bytes that Spark hands to Python at once: texts are long, and each is copied on the way in and out.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; the others go. Where no language was learned, none can be told and letters alone decide."""
    bounded(spark)
    found, langs = langid.fitted(packed(docs, "doc_id", "text", "lang"))
    told = F.col("lang_pred") != langid.UNDETERMINED if langs else langid.has_letter(F.col("text"))
    return unpacked(found.where(told), docs.columns, "doc_id", "text", "lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    bounded(spark)
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` is that of the new text."""
    bounded(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, once for each round of its source."""
    bounded(spark)
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("best-fit packing", sequences),
]
#: SQL cannot express the models and the tokenizer; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        with scratch(spark):  # what the stage wrote on its way goes once its result is there
            docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "_"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
