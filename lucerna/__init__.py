"""lucerna: interpretable tabular machine learning as Spark DataFrame operators.

Every public operator takes DataFrames (and column names / parameters) and
returns a DataFrame or a fitted Spark ML model.  Only bounded aggregates
(counts, quantile boundaries, fitted coefficients) ever reach the driver.
"""

from lucerna.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
