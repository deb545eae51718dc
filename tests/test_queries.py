"""Every registered query beside its SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare

from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    line = compare(spark, FOLDER, name, catalog.queries()[name], catalog.oracle_sql().get(name))
    assert not line.startswith("DIFFERENT"), line
