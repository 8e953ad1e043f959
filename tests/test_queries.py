"""Every query with SQL gives the SQL's rows; the others give rows with a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    assert compare(entry.queries()[name](spark, SF), db, entry.oracle_sql()[name]) == []


def own(name):
    """Queries of the library; those of its optional part have tests of their own."""
    return not entry.queries()[name].__module__.startswith(("labelloom.llm", "corpus_pipeline"))


@pytest.mark.parametrize("name", sorted(filter(own, set(entry.queries()) - set(entry.oracle_sql()))))
def test_query_without_sql_gives_rows(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.limit(5).collect()
    assert rows and list(rows[0].asDict()) == df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
