"""Every query that has SQL gives the rows of its SQL."""

import pytest
from compare import database, same

from lotline.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, db, name):
    same(QUERIES[name](spark, sf), ORACLES[name], db)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
