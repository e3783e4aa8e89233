"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry_points
from compare import difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


SUBPACKAGE = "pseudospark.llm."  # its queries that SQL cannot express have tests of their own


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert difference(spark, QUERIES[name], ORACLE[name], SF_DIR) is None


def test_only_some_queries_have_no_sql():
    assert set(ORACLE) <= set(QUERIES)
    others = [name for name in QUERIES if name not in ORACLE and not QUERIES[name].__module__.startswith(SUBPACKAGE)]
    assert not others


def test_entry(spark):
    assert entry_points.entry(spark).count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
