"""The driver contract on the smallest tables: every query with SQL equals it."""

import os

import pytest

import __spark_entry__ as entry
from compare import rows, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    rel = views(SF).execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, rel.fetchall())
