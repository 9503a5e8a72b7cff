"""Every linkage query against its SQL, and the Python ones against small checks."""

import pytest

from kinfold import catalogue
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, sf, db, name):
    assert_same(catalogue.QUERIES[name](spark, sf), db, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_without_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(catalogue.ORACLE) <= set(entry.oracle_sql())
