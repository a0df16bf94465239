"""Every query of the engine against its SQL, and those without SQL for their rows."""

import pytest

from tests.oracle import assert_same, connect
from treeloom import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, FOLDER), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_without_sql(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 5
