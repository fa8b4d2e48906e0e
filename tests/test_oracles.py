"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import pytest

import __spark_entry__ as entry
from stopdelay.queries import QUERIES, SQL
from tests.oracle import compare

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, what = compare(spark, D, QUERIES[name], SQL.get(name))
    assert ok, what


def test_entry_works_without_the_training_data_operators(spark, tmp_path):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for top, folders, files in os.walk(os.path.join(here, "stopdelay")):
        if os.path.basename(top) == "llm":
            folders.clear()
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(top, f)).read(), f
