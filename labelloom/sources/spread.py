"""Partitioning of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Shuffle by id when the input has fewer splits than the cluster has cores, else nothing.

    A table of one row group would keep all text work in one task. A table large enough for the
    shuffle to matter has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, id_col)
