"""Every registered query of the subpackage runs on the smallest tables with a stable schema."""

from pathlib import Path

import pytest

from tessera.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert df.columns and (rows or name.startswith(("p2", "p9")))
    wanted = {"p4_found": [("file_id", "bigint"), ("line_no", "int")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p6_found": [("symbol_id", "bigint")]}
    if name in wanted:
        assert df.dtypes == wanted[name]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
