"""Every registered query against its SQL, over the smallest tables."""

import pytest

import __spark_entry__
from marginalia.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_against_sql(spark, sf_dir, con, name):
    assert compare(spark, name, registry.QUERIES[name], registry.SQL[name], con, sf_dir) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
