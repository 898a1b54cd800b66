"""Pipeline stages for models that Spark ML lacks: saved with a pipeline, scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MarginModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``, and for classes ``probability`` (an array), from a model's raw outputs.

    A subclass turns the saved JSON into an object with ``features``, ``task``,
    ``outputs`` (1 for numbers and two classes, else the number of classes) and
    ``margins(x)`` for a matrix of rows, NaN where a feature is missing.  Equal
    probabilities go to the first class.
    """

    state = Param(Params._dummy(), "state", "the fitted model as JSON", TypeConverters.toString)

    def __init__(self, state: str | None = None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    def load_state(self, text: str):
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self.load_state(self.getOrDefault(self.state))
        name = "_margin"
        while name in {c.lower() for c in dataset.columns}:
            name += "_"

        @F.pandas_udf("array<double>")
        def margin(*xs: pd.Series) -> pd.Series:
            return pd.Series(list(model.margins(np.column_stack([x.to_numpy(float) for x in xs]))))

        out = dataset.withColumn(name, margin(*[F.col(f"`{c}`").cast("double") for c in model.features]))
        m = F.col(name)
        if model.task == "regression":
            return out.withColumn("prediction", m[0]).drop(name)
        if model.outputs == 1:
            p = 1.0 / (1.0 + F.exp(-m[0]))
            chances = F.array(1.0 - p, p)
        else:
            shares = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
            chances = F.transform(shares, lambda e: e / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("probability", chances).drop(name)
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
