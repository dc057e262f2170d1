"""Every registered query with an oracle equals its DuckDB SQL (multiset of rows)."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E
from mailspark.sources.fixtures import FEATURE_MATRIX_FEATURES, feature_matrix

ORACLE = E.oracle_sql()
QUERIES = E.queries()
CON = {}


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) >= 40


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = CON.setdefault("c", duck(SF_SMALL))
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF_SMALL, con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["values_match"], r


def test_scaling_is_checked_on_the_column_with_nulls(spark):
    df = QUERIES["standard_scale_all"](spark, SF_SMALL)
    assert "standard_scale_all" in ORACLE and set(df.columns) == {"mail_id", "fold", *FEATURE_MATRIX_FEATURES}
    missing = df.where("subject_len IS NULL").count()
    assert 0 < missing < df.count()
    assert missing == feature_matrix(spark, SF_SMALL).where("subject_len IS NULL").count()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 81
    assert set(df.columns) == {"feature", "mean_ham", "mean_spam"}
