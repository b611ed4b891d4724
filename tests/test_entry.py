import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["tbl", "row_id", "field", "redacted", "n"] and entry.entry(spark).count() > 0


def test_core_does_not_import_the_optional_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "quietlines")
    for folder, _, files in os.walk(root):
        if os.path.relpath(folder, root).split(os.sep)[0] != "llm":
            for name in files:
                if name.endswith(".py"):
                    assert "quietlines.llm" not in open(os.path.join(folder, name)).read()
