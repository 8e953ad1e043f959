"""Files written from the tables and read back."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelloom.sources import files, sinks
from labelloom.staging import fresh_path
from queries.common import CORPUS_SQL, bigints, corpus, rounded, scores_sql, stand_in_scores, table

SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())]
)


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def _paths(spark, folder):
    return [row["path"] for row in spark.read.format("binaryFile").load(folder).select("path").collect()]


def _told(rows):
    return rows.select("doc_id", F.md5("text").alias("digest"), "lang")


def _written(spark, sf, **options):
    path = fresh_path(spark, "documents")
    _documents(spark, sf).write.options(header=True, quote='"', escape='"', **options).csv(path)
    return _paths(spark, path)


def write_table(spark, sf):
    path = fresh_path(spark, "documents")
    sinks.write_table(_documents(spark, sf), path)
    return _told(files.read_csv_table(spark, _paths(spark, path), SCHEMA))


def read_csv_table(spark, sf):
    return _told(files.read_csv_table(spark, _written(spark, sf), SCHEMA))


def read_csv_table_gzip(spark, sf):
    return _told(files.read_csv_table(spark, _written(spark, sf, compression="gzip"), SCHEMA))


FILES = 8
#: Bytes of text in an archive where the number of files is free.
FILE_BYTES = 64 << 20
FORMS = ("csv", "gzip", "zip")


def _target(form, sink, name):
    """An open text file of the given form, and what is to be closed in order."""
    if form == "gzip":
        packed = gzip.GzipFile(fileobj=sink, mode="wb")
    elif form == "zip":
        archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
        packed = archive.open(name + ".csv", "w", force_zip64=True)
        text = io.TextIOWrapper(packed, encoding="utf-8", newline="")
        return text, [text, archive, sink]
    else:
        packed = sink
    text = io.TextIOWrapper(packed, encoding="utf-8", newline="")
    return text, [text, *([] if form == "csv" else [sink])]


def _bucketed(rows, bucket, n):
    """Rows with the number of their file, every file's rows in a partition of their own; rows without a number in the first."""
    return rows.withColumn("bucket", bucket).repartitionById(n, F.coalesce("bucket", F.lit(0)).cast("int"))


def _packed_files(spark, sf, form, n=FILES, bucket=None):
    """The documents as ``n`` files of one form, by ``doc_id``, each written row batch by row batch."""
    path = fresh_path(spark, form)

    def write(batches):
        number, text, closing = None, None, []
        for batch in batches:
            for own, rows in batch.groupby("bucket", sort=False):
                if own != number:
                    for part in closing:
                        part.close()
                    name = f"documents-{own}"
                    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                    system.create_dir(place)
                    sink = system.open_output_stream(f"{place}/{name}.{form}", compression=None)
                    text, closing = _target(form, sink, name)
                    rows.drop(columns="bucket").to_csv(text, index=False)
                    number = own
                    yield pd.DataFrame({"bucket": [own]})
                else:
                    rows.drop(columns="bucket").to_csv(text, index=False, header=False)
        for part in closing:
            part.close()

    bucket = F.pmod(F.col("doc_id"), F.lit(n)) if bucket is None else bucket
    rows = _bucketed(_documents(spark, sf).select("doc_id", "text", "lang"), bucket, n)
    rows.sortWithinPartitions("bucket").mapInPandas(write, "bucket long").count()
    return path


def read_csv_table_zip(spark, sf):
    """The documents packed into zip archives, as many as their size asks for, and the archives opened again."""
    size = _documents(spark, sf).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(FILES, -(-size // FILE_BYTES))
    # By a hash, as ids may follow any pattern.
    bucket = F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    return _told(files.read_csv_table(spark, [_packed_files(spark, sf, "zip", n, bucket)], SCHEMA, "documents"))


def sniff_files(spark, sf):
    """The type of every file of the documents written in three forms, and of the Parquet tables."""
    paths = [_packed_files(spark, sf, form) for form in FORMS] + [f"{sf}/documents.parquet", f"{sf}/labels.parquet"]
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return files.sniff_files(spark, paths).select(name.alias("file"), "type", "header")


def reject_unreadable(spark, sf):
    _, rejected = files.reject_unreadable(files.sniff_files(spark, [f"{sf}/documents.parquet", f"{sf}/labels.parquet"]))
    return rejected.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "type")


def null_tokens(spark, sf):
    """Languages replaced by missing-value tokens for one document in three."""
    tokens = F.array(*[F.lit(t) for t in files.NULL_TOKENS])
    token = F.element_at(tokens, (F.col("doc_id") % len(files.NULL_TOKENS) + 1).cast("int"))
    rows = _documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, token).otherwise(F.col("lang")).alias("lang"))
    return files.null_tokens(rows, ["lang"])


def file_manifest(spark, sf):
    return files.file_manifest(spark, [f"{sf}/documents.parquet", f"{sf}/labels.parquet"])


def table_shape(spark, sf):
    return bigints(files.table_shape(table(spark, sf, "documents")), "columns")


def _written_scores(spark, sf):
    path = fresh_path(spark, "scores")
    sinks.write_scores(stand_in_scores(corpus(spark, sf)), path)
    return spark.read.parquet(path)


def write_scores(spark, sf):
    kept = _written_scores(spark, sf)
    return bigints(rounded(kept.select("doc_id", "candidate", "label", "score", "truth"), "score"), "truth")


def score_shape(spark, sf):
    return sinks.score_shape(_written_scores(spark, sf), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        write_table, read_csv_table, read_csv_table_gzip, read_csv_table_zip, sniff_files, reject_unreadable,
        null_tokens, file_manifest, table_shape, write_scores, score_shape,
    )
}
DOCUMENTS_SQL = "SELECT doc_id, md5(text) AS digest, lang FROM documents"
ORACLES = {
    "write_table": DOCUMENTS_SQL,
    "read_csv_table": DOCUMENTS_SQL,
    "read_csv_table_gzip": DOCUMENTS_SQL,
    "read_csv_table_zip": DOCUMENTS_SQL,
    "sniff_files": f"""WITH numbers AS (SELECT DISTINCT doc_id % {FILES} AS k FROM documents)
SELECT 'documents-' || k || '.' || form AS file, form AS type, CASE WHEN form <> 'zip' THEN 'doc_id,text,lang' END AS header
FROM numbers, (VALUES {", ".join(f"('{form}')" for form in FORMS)}) f(form)
UNION ALL SELECT unnest(['documents.parquet', 'labels.parquet']), 'unknown', NULL""",
    "reject_unreadable": "SELECT unnest(['documents.parquet', 'labels.parquet']) AS file, 'unknown' AS type",
    "null_tokens": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents",
    "table_shape": """SELECT count(*) AS rows, (SELECT count(*) FROM information_schema.columns
  WHERE table_name = 'documents') AS columns FROM documents""",
    "write_scores": f"""WITH {CORPUS_SQL}, {scores_sql("corpus")}
SELECT doc_id, candidate, label, round(score, 6) AS score, CAST(truth AS BIGINT) AS truth FROM scored""",
    "score_shape": f"""WITH {CORPUS_SQL}, {scores_sql("corpus")}
SELECT count(DISTINCT candidate) AS candidates, count(DISTINCT label) AS labels, count(*) AS cells,
  count(DISTINCT doc_id) AS rows,
  count(*) = count(DISTINCT doc_id) * count(DISTINCT candidate) * count(DISTINCT label) AS complete FROM scored""",
}
