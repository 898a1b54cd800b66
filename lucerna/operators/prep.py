"""EN1-EN10: dataset preparation (encoder).

Column decisions (which columns are empty, constant, dates, or categorical
and with which values) are taken from one aggregate pass each; only those
per-column results -- bounded by the number of columns, and for one-hot by
``max_categories`` -- reach the driver.  Row work stays in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

DATE_FORMAT = "MM/dd/yyyy"  # fixed: the only date layout recognised


def _numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _string_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    n = row["__n"]
    return {c: n - row[c] for c in df.columns} | {"__n": n}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """EN1: drop columns whose values are all null."""
    nc = null_counts(df)
    return df.drop(*[c for c in df.columns if nc[c] == nc["__n"]])


def drop_empty_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """EN2: drop rows whose values (in ``subset``, default all) are all null."""
    return df.dropna(how="all", subset=list(subset) if subset else None)


def drop_by_null_ratio(df: DataFrame, ratio: float = 100.0,
                       keep: Sequence[str] = ()) -> DataFrame:
    """EN3: drop columns (not in ``keep``) with ``100 * nulls / n >= ratio``."""
    nc = null_counts(df)
    n = nc["__n"]
    drop = [c for c in df.columns if c not in keep and n > 0 and 100.0 * nc[c] / n >= ratio]
    return df.drop(*drop)


def drop_by_variance(df: DataFrame, threshold: float = 0.0,
                     keep: Sequence[str] = ()) -> DataFrame:
    """EN4: drop numeric columns (not in ``keep``) with sample variance <= threshold.

    A column whose variance is undefined (fewer than two values) is kept.
    """
    cols = _numeric_cols(df, keep)
    if not cols:
        return df
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if row[c] is not None and row[c] <= threshold])


def date_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """EN5 as a table: ``column, is_date`` for each string column.

    A column is a date column when every non-null value parses as MM/dd/yyyy
    (a column without values is not).
    """
    cols = list(cols) if cols is not None else _string_cols(df)
    parsed = [F.struct(F.lit(c).alias("column"),
                       F.min(F.when(F.col(c).isNull(), None)
                             .when(F.try_to_timestamp(F.col(c), F.lit(DATE_FORMAT)).isNull(), 0)
                             .otherwise(1)).alias("ok"))
              for c in cols]
    return (df.agg(F.array(*parsed).alias("a")).select(F.explode("a").alias("s"))
            .select("s.column", F.coalesce(F.col("s.ok") == 1, F.lit(False)).alias("is_date")))


def encode_date(df: DataFrame, c: str) -> DataFrame:
    """EN6: MM/dd/yyyy text to epoch seconds (UTC); null stays null."""
    ts = F.unix_timestamp(F.try_to_timestamp(F.col(c), F.lit(DATE_FORMAT))).cast("double")
    return df.withColumn(c, ts)


def one_hot(df: DataFrame, c: str, max_categories: int = 1000) -> DataFrame:
    """EN7: ``c_<value>`` 0/1 columns plus ``c_nan``; the original is dropped.

    The distinct values are a bounded aggregate (checked against
    ``max_categories``); above that bound use :func:`one_hot_vector`.
    """
    vals = (df.select(c).where(F.col(c).isNotNull()).distinct()
            .limit(max_categories + 1).collect())
    if len(vals) > max_categories:
        raise ValueError(f"{c}: more than {max_categories} categories; use one_hot_vector")
    values = sorted(r[0] for r in vals)
    new = [F.when(F.col(c) == v, 1).otherwise(0).cast("long").alias(f"{c}_{v}") for v in values]
    new.append(F.when(F.col(c).isNull(), 1).otherwise(0).cast("long").alias(f"{c}_nan"))
    return df.select(*[x for x in df.columns if x != c], *new)


def one_hot_vector(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """EN7 for high cardinality: index + one-hot vector (null kept as its own slot)."""
    from pyspark.ml.feature import OneHotEncoder
    out = out or f"{c}_vec"
    idx = StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                        stringOrderType="alphabetAsc").fit(df).transform(df)
    enc = OneHotEncoder(inputCol=f"{c}_idx", outputCol=out, dropLast=False, handleInvalid="keep")
    return enc.fit(idx).transform(idx).drop(c, f"{c}_idx")


def encode_target(df: DataFrame, target: str, out: str | None = None) -> DataFrame:
    """EN8: drop rows without target, label-encode in the order of the values (numbers as numbers), move it last."""
    from lucerna.functions.ranking import row_number_by_value
    out = out or target
    kept = df.where(F.col(target).isNotNull())
    values = kept.select(target).distinct()
    kind = df.schema[target].dataType.typeName()
    if kind in ("boolean", "date", "timestamp", "timestamp_ntz", "binary"):
        values = values.withColumn("__rn", F.row_number().over(Window.orderBy(target)))  # few values by nature
    else:
        values = row_number_by_value(values, target, None, "__rn")
    values = values.select(F.col(target).alias("__value"), (F.col("__rn") - 1).cast("int").alias("__lbl"))
    rest = [c for c in df.columns if c != target]
    return kept.join(values, kept[target] == values["__value"]).select(*rest, F.col("__lbl").alias(out))


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """EN9: numeric nulls replaced by the column mean (one aggregate pass)."""
    cols = list(cols) if cols is not None else _numeric_cols(df)
    if not cols:
        return df
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c)
                       if c in cols and means[c] is not None else F.col(c) for c in df.columns])


def encode_table(df: DataFrame, id_col: str | None = None, target: str | None = None,
                 ratio_null: float = 100.0, variance: float = 0.0,
                 max_categories: int = 1000) -> DataFrame:
    """EN10: EN1 -> EN2 -> EN3 -> EN4 -> EN5/6/7 -> EN8 -> EN9.

    Defaults to the positional roles (first column = id, last = target).
    """
    id_col = id_col or df.columns[0]
    target = target or df.columns[-1]
    keep = [id_col, target]
    nums = _numeric_cols(df, keep)
    strs = _string_cols(df, keep)
    all_null = F.lit(True)
    for c in df.columns:
        all_null = all_null & F.col(c).isNull()
    # One pass decides EN1, EN3, EN4 and EN5 for every column: non-null
    # counts, all-null rows, sample variances and date parse results.
    prof = df.agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(F.when(all_null, 1).otherwise(0)).alias("__empty_rows"),
        *[F.count(F.col(c)).alias(f"n__{c}") for c in df.columns],
        *[F.var_samp(F.col(c).cast("double")).alias(f"v__{c}") for c in nums],
        *[F.min(F.when(F.col(c).isNull(), None)
                .when(F.try_to_timestamp(F.col(c), F.lit(DATE_FORMAT)).isNull(), 0)
                .otherwise(1)).alias(f"d__{c}") for c in strs]).first()
    n = prof["__n"] - (prof["__empty_rows"] or 0)
    drop = {c for c in df.columns if prof[f"n__{c}"] == 0}                          # EN1
    drop |= {c for c in df.columns if c not in keep and n > 0 and c not in drop
             and 100.0 * (n - prof[f"n__{c}"]) / n >= ratio_null}                   # EN3
    drop |= {c for c in nums if prof[f"v__{c}"] is not None
             and prof[f"v__{c}"] <= variance}                                       # EN4
    df = drop_empty_rows(df.drop(*drop))                                             # EN2
    for c in [s for s in strs if s not in drop]:
        df = encode_date(df, c) if prof[f"d__{c}"] == 1 else one_hot(df, c, max_categories)
    df = encode_target(df, target)                                                   # EN8
    return impute_mean(df, [c for c in _numeric_cols(df) if c not in keep])         # EN9
