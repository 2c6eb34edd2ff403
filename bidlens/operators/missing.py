"""A fitted policy for missing numbers: values learned in training take the place of null and NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(column: str) -> Column:
    """The number as a double, or null where it is null or NaN."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


class _MissingParams(HasInputCols):
    strategy = Param(Params._dummy(), "strategy", "mean of the known values, or zero", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(strategy="mean")


class FillMissing(Estimator, _MissingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learn a value per numeric column, all in one aggregate: the mean of its known values, or 0.

    A column without any known value gets 0.
    """

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, strategy: str = "mean"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FillMissingModel:
        columns, how = self.getInputCols(), self.getOrDefault(self.strategy)
        if how not in ("mean", "zero"):
            raise ValueError(f"no such strategy: {how}")
        values = [0.0] * len(columns)
        if how == "mean":
            row = dataset.agg(*[F.coalesce(F.avg(present(c)), F.lit(0.0)) for c in columns]).first()
            values = list(row)
        return FillMissingModel(columns, values)


class FillMissingModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns with the learned value where they are null or NaN; all become doubles."""

    fills = Param(Params._dummy(), "fills", "value of each input column where it is missing", typeConverter=TypeConverters.toListFloat)

    def __init__(self, inputCols: Sequence[str] | None = None, fills: Sequence[float] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols), fills=list(fills or ()))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getInputCols(), self.getOrDefault(self.fills))
        return dataset.withColumns({c: F.coalesce(present(c), F.lit(v)) for c, v in pairs})
