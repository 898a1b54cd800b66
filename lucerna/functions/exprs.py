"""Small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 6) -> Column:
    """Round half up on the binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Written with plain IEEE operations so every engine gives the same double
    (Spark's ``round`` goes through the decimal string of the double, DuckDB's
    through the binary value; the two disagree on inputs such as 0.145).
    """
    scale = float(10 ** digits)
    return (F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def dec2(c) -> Column:
    """Money / quantity columns as DECIMAL(18,2) so sums are exact."""
    return col(c).cast("decimal(18,2)")


def safe_div(num, den, default=0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or null."""
    d = col(den)
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(col(num) / d)


def logistic(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def scalars(one_row) -> dict:
    """Values of a one-row aggregate (bounded by its column count) as a dict."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one aggregate row, got {len(rows)}")
    return rows[0].asDict()


def with_scalars(df, one_row):
    """Attach the columns of a one-row aggregate to every row as literals.

    Replaces a join with a one-row table: the values are read once (a handful
    of numbers) and become constants in the generated code.
    """
    vals = scalars(one_row)
    return df.select("*", *[_literal(v).alias(k) for k, v in vals.items()])


def _literal(v) -> Column:
    from pyspark.sql import Row
    if isinstance(v, Row):
        return F.struct(*[_literal(x).alias(k) for k, x in v.asDict().items()])
    if isinstance(v, (list, tuple)):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)
