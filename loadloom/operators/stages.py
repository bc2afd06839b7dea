"""The forecaster as pipeline stages: hourly rows in, corrected forecasts out, all of it in one PipelineModel.

What a stage learns per series (scaler, bias) is a table; it is saved as Parquet beside the stage's parameters, so
a saved pipeline holds everything that scoring needs, for any number of series.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import ExitStack

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, functions as F

from ..config import CHANNELS, ForecastConfig
from .evaluate import fit_bias, subtract_bias
from .features import feature_table, scaler_params
from .linear import Ridge
from .models import feature_names, held, long_forecasts
from .windows import check_latest, lag_features


class _TableWriter(MLWriter):
    def __init__(self, instance: "TableModel") -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind: type["TableModel"]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "TableModel":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.kind.__module__}.{self.kind.__name__}")
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = self.sparkSession.read.parquet(f"{path}/table")
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A model whose learned part is a DataFrame with a row per series."""

    table: DataFrame

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _Value(Params):
    value = Param(Params._dummy(), "value", "column of the load", TypeConverters.toString)


class ScaledFeatures(TableModel, _Value):
    """The feature table of hourly rows, scaled with the parameters learned from the train rows."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return feature_table(dataset, self.getOrDefault(self.value), params=self.table)


class FeatureScaler(Estimator, _Value, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of :class:`ScaledFeatures`; needs the columns of :func:`feature_table`."""

    @keyword_only
    def __init__(self, *, value="load"):
        super().__init__()
        self._setDefault(value="load")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScaledFeatures:
        model = ScaledFeatures()
        model._set(value=self.getOrDefault(self.value))
        model.table = scaler_params(dataset, self.getOrDefault(self.value))
        return model


class LagFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features of every origin with targets, or with ``latest`` those of each series' last hour.

    With ``latest`` a series shorter than the history is a ValueError, found by a job.
    """

    history = Param(Params._dummy(), "history", "hours of a window", TypeConverters.toInt)
    horizon = Param(Params._dummy(), "horizon", "steps ahead", TypeConverters.toInt)
    seasonal_diff = Param(Params._dummy(), "seasonal_diff", "targets are seasonal differences", TypeConverters.toBoolean)
    channels = Param(Params._dummy(), "channels", "channels with statistics", TypeConverters.toListString)
    latest = Param(Params._dummy(), "latest", "last hour instead of origins", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, history=48, horizon=24, seasonal_diff=False, channels=CHANNELS, latest=False):
        super().__init__()
        self._setDefault(history=48, horizon=24, seasonal_diff=False, channels=list(CHANNELS), latest=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cfg = ForecastConfig(history=self.getOrDefault(self.history), horizon=self.getOrDefault(self.horizon),
                             seasonal_diff=self.getOrDefault(self.seasonal_diff))
        latest, channels = self.getOrDefault(self.latest), self.getOrDefault(self.channels)
        carry = ("consumption_min", "consumption_max")
        if latest:
            check_latest(dataset, cfg.history, channels)
            dataset = dataset.where((F.col("n") >= cfg.history) & (F.col("pos") >= F.col("n") - cfg.history))
            return lag_features(dataset, cfg, channels, latest=True, carry=carry)
        return lag_features(dataset, cfg, channels, carry=("n", "split_n", *carry))


class Forecasts(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Long forecasts in original units from the columns ``pred_{h}``, with the truth where there is one."""

    model = Param(Params._dummy(), "model", "name of the model", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "steps ahead", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, model="ridge", steps=None):
        super().__init__()
        self._setDefault(model="ridge")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return long_forecasts(dataset, self.getOrDefault(self.steps), self.getOrDefault(self.model),
                              with_truth="y" in dataset.columns)


class BiasFree(TableModel):
    """Forecasts without the bias of their series and model; those without a stored one stay."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return subtract_bias(dataset, self.table)


class BiasCorrection(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of :class:`BiasFree` on long forecasts with truth."""

    split = Param(Params._dummy(), "split", "rows to learn from", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, split="val"):
        super().__init__()
        self._setDefault(split="val")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BiasFree:
        model = BiasFree()
        model.table = fit_bias(dataset, self.getOrDefault(self.split))
        return model


#: Place of the regression among the stages of :func:`forecaster`.
TUNED = 2


def forecaster(cfg: ForecastConfig, channels: Sequence[str] = CHANNELS, alpha: float = 1.0, value: str = "load",
               name: str = "ridge") -> list:
    """The stages from hourly rows with a split to corrected forecasts: ``Pipeline(stages=forecaster(…))``."""
    steps = list(range(1, cfg.horizon + 1))
    return [FeatureScaler(value=value),
            LagFeatures(history=cfg.history, horizon=cfg.horizon, seasonal_diff=cfg.seasonal_diff,
                        channels=list(channels)),
            Ridge(inputs=feature_names(cfg, channels), steps=steps, alpha=alpha, split="train"),
            Forecasts(model=name, steps=steps), BiasCorrection()]


def for_latest(model: PipelineModel) -> PipelineModel:
    """The same model forecasting from the last hour of each series."""
    return PipelineModel([s.copy({s.latest: True}) if isinstance(s, LagFeatures) else s for s in model.stages])


def _applied(stages: Sequence, rows: DataFrame) -> tuple[list, DataFrame]:
    """Fit and apply stages one after the other."""
    done = []
    for stage in stages:
        done.append(stage.fit(rows) if isinstance(stage, Estimator) else stage)
        rows = done[-1].transform(rows)
    return done, rows


class ChronologicalValidator(Estimator):
    """The pipeline whose parameter map has the lowest mean absolute error on the later rows of split ``split``.

    ``grid`` (of a ParamGridBuilder) may name parameters of one stage. Stages before it are fitted and applied once and
    their rows held, the stage itself learns all maps with ``fitMultiple``, and stages behind it are fitted per map.
    Ties go to the earlier map. The fitted PipelineModel has ``validation``: pairs of parameters and error, in grid order.
    """

    def __init__(self, stages: Sequence, grid: Sequence[dict], split: str = "val") -> None:
        super().__init__()
        if not grid:
            raise ValueError("no parameter maps")
        owners = {p.parent for m in grid for p in m}
        at = [i for i, s in enumerate(stages) if s.uid in owners]
        if len(owners) > 1 or len(at) != len(owners):
            raise ValueError("the grid must name parameters of one stage")
        self.stages, self.grid, self.split = list(stages), list(grid), split
        self.at = at[0] if at else len(self.stages) - 1

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        before, rows = _applied(self.stages[:self.at], dataset)
        results: dict[int, tuple[float, list]] = {}
        with ExitStack() as stack:
            if before:
                rows = stack.enter_context(held(rows))
            for i, model in self.stages[self.at].fitMultiple(rows, self.grid):
                after, scored = _applied(self.stages[self.at + 1:], model.transform(rows))
                error = scored.where(F.col("split") == self.split).agg(F.avg(F.abs(F.col("y") - F.col("y_pred")))).first()[0]
                results[i] = (float("inf") if error is None else error, [model, *after])
        best = min(results, key=lambda i: (results[i][0], i))
        found = PipelineModel([*before, *results[best][1]])
        found.validation = [({p.name: v for p, v in m.items()}, results[i][0]) for i, m in enumerate(self.grid)]
        return found
