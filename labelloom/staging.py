"""Tables written once to the shared folder, so that later jobs neither recompute them nor
depend on the executor that made them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: How tables of few large records are written. Parquet otherwise looks at the size of a page and of a row group after a hundred
#: records, and a reader takes a whole row group at once.
LARGE_RECORDS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size": str(1 << 24),
    "compression": "uncompressed",
}
_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="labelloom-")
    return _local_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/labelloom-{uuid.uuid4().hex}/{name}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, what was staged in it and not kept.

    Whatever is used after the block must be kept or hang on nothing that was staged here.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to a fresh path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str, keep: bool = False, large: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage like a checkpoint, but computes ``df`` once and keeps column pruning
    and filter pushdown for the readers. Inside ``scratch`` the table lives until the block ends; ``keep`` makes it
    outlive that block, for a result. ``large`` is for records of megabytes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.options(**(LARGE_RECORDS if large else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
