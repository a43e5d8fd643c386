"""Feature stages with the source's definitions, as ``pyspark.ml`` estimators
that fit in a ``Pipeline``, save and load.

The built-in imputer takes approximate medians, and the built-in scaler divides
by the sample deviation; here medians are exact (found by ranges, see
:func:`assaykit.operators.rows.exact_quantiles`) and deviations are those of
the population. Both work on columns, so that the transformations stay
built-in expressions and no vector is built for them.
"""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import exact_quantiles


def _number(col: str) -> Column:
    """The column as double, NaN read as missing."""
    x = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(x), x)


class _Columns(HasInputCols, HasOutputCols, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """``weightCol`` holds counts, where a row stands for several rows of the fit."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, weightCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _weight(self) -> str | None:
        return self.getWeightCol() if self.isDefined(self.weightCol) else None


class ExactMedianImputer(_Columns, Estimator):
    """Fills nulls and NaN of each column with its exact median; a column
    without any value is filled with 0."""

    def _fit(self, dataset: DataFrame) -> ExactMedianImputerModel:
        cols = self.getInputCols()
        # One row per column.
        found = {r["column_name"]: r["q"][0] for r in exact_quantiles(dataset, cols, [0.5], self._weight()).collect()}
        model = ExactMedianImputerModel(inputCols=cols, outputCols=self.getOutputCols())
        return model._set(medians=[float(found.get(c, 0.0)) for c in cols])


class ExactMedianImputerModel(_Columns, Model):
    medians = Param(Params._dummy(), "medians", "median of each input column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians))
        return dataset.withColumns({out: F.coalesce(_number(c), F.lit(m)) for c, out, m in told})


class PopulationScaler(_Columns, Estimator):
    """Subtracts the mean and divides by the population deviation; a column
    without spread is only centred."""

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols, weight = self.getInputCols(), self._weight()
        if weight:
            means = dataset.agg(*[self._mean(_number(c), weight) for c in cols]).first()
            devs = dataset.agg(*[F.sqrt(self._mean((_number(c) - F.lit(m)) ** 2, weight)) for c, m in zip(cols, means)]).first()
        else:
            row = dataset.agg(*[F.avg(_number(c)) for c in cols], *[F.stddev_pop(_number(c)) for c in cols]).first()
            means, devs = row[:len(cols)], row[len(cols):]
        model = PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols())
        return model._set(means=[float(m or 0.0) for m in means], deviations=[float(d or 1.0) for d in devs])

    @staticmethod
    def _mean(x: Column, weight: str) -> Column:
        """The mean over the rows that the rows stand for; that of a column of one value is the value."""
        return F.when(F.min(x) == F.max(x), F.max(x)).otherwise(F.try_divide(F.sum(x * F.col(weight)), F.sum(F.when(x.isNotNull(), F.col(weight)))))


class PopulationScalerModel(_Columns, Model):
    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation, 1 where it is 0", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return dataset.withColumns({out: (_number(c) - F.lit(m)) / F.lit(d) for c, out, m, d in told})
