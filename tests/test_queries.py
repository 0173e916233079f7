"""Every registered query beside its SQL twin, on whole tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def plain(spark):
    """A session with Spark's own settings: names are one in any case."""
    session = spark.newSession()
    session.conf.set("spark.sql.caseSensitive", "false")
    for name in ("spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.execution.arrow.pyspark.enabled"):
        session.conf.unset(name)
    return session


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(plain, con, name):
    ok, detail = compare(plain, con, SF, QUERIES[name], ORACLES.get(name))
    assert ok, detail


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
