"""Arrow-batched pandas UDFs.  (No postponed annotations here: Spark reads the
pandas type hints at definition time.)"""

import pandas as pd
from pyspark.sql.functions import pandas_udf


@pandas_udf("double")
def t_test_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of Pearson r over n pairs, one value per row."""
    from lucerna.functions.special import t_two_sided_p
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(r, n)], dtype="float64")

