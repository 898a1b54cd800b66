"""Fitted / randomised queries (no SQL oracle) run and give rows."""

import pytest

from lucerna.plans.catalog import oracle_queries, spark_queries

QS = spark_queries()
ROWS_ONLY = sorted(set(QS) - set(oracle_queries()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, sf_small, name):
    df = QS[name](spark, sf_small)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns) > 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert {r["section"] for r in rows} == {"metric", "shapley"}
    assert set(df.columns) == {"section", "name", "value"}
