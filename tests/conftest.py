"""One local session for all tests."""

from __future__ import annotations

import tempfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession

import labelloom

cloudpickle.register_pickle_by_value(labelloom)


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("labelloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="labelloom-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()
