"""Queries with SQL equal DuckDB on whole tables; all queries give stable schemas."""

import pytest

from oracle_check import compare

from mailspark.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    r = compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert r["cols_match"] and r["values_match"], r


def test_one_query_per_operator():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
