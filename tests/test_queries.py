import os

import pytest

from quarry import catalog
from tests.oracle import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_point():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
