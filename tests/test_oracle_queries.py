"""Every SQL-checked query against its DuckDB oracle (small scale, float tolerance).

The exact bit-for-bit comparison the driver makes is ``python tests/run_oracle.py``
at sf0.01; here values are compared with a 2e-6 tolerance so that rounding ties
of this small fixture do not hide real differences.
"""

import math

import pytest

from lucerna.plans.catalog import oracle_queries, spark_queries
from tests.oracle import duck

SQL = oracle_queries()
QS = spark_queries()


def _key(row):
    return tuple((x is None, round(float(x), 3) if isinstance(x, (int, float)) and not isinstance(x, bool)
                  else str(x)) for x in row)


def _close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is None and b is None
        if math.isnan(a) and math.isnan(b):
            return True
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def _rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df.to_dict("records"):
        row = []
        for c in cols:
            v = r[c]
            if hasattr(v, "item"):
                v = v.item()
            if isinstance(v, float) and math.isnan(v):
                v = None
            if isinstance(v, float) and v.is_integer() and abs(v) < 2 ** 53:
                v = int(v)   # nullable integer columns arrive as float64 from pandas
            row.append(v)
        out.append(tuple(row))
    return sorted(out, key=_key)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_small, con, name):
    left = QS[name](spark, sf_small).toPandas()
    right = con.execute(SQL[name]).df()
    assert sorted(left.columns) == sorted(right.columns)
    assert len(left) == len(right)
    a, b = _rows(left), _rows(right)
    bad = [(x, y) for x, y in zip(a, b) if not all(_close(p, q) for p, q in zip(x, y))]
    assert not bad, bad[:3]
