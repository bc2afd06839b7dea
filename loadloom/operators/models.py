"""Ridge and boosted-tree forecasters on per-origin features.

A forecaster is a PipelineModel: one linear stage for all steps ahead, or an assembler and one tree regression per
step. All horizons share one feature table, so the windows are computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import CHANNELS, ForecastConfig, TreeConfig
from .features import feature_table, reconstruct, unscale
from .linear import LinearSteps, cross_products, linear_steps
from .windows import check_latest, lag_feature_names, lag_features

KINDS = ("ridge", "gbt")


def flatten_windows(windows: DataFrame, out: str = "features") -> DataFrame:
    """Window arrays (L × F) to one vector of L·F numbers."""
    return windows.withColumn(out, array_to_vector(F.flatten("x")))


def model_table(df: DataFrame, cfg: ForecastConfig, channels: Sequence[str] = CHANNELS,
                value: str = "load") -> DataFrame:
    """Scaled features and targets of every origin: the input of fit and predict."""
    features = feature_table(df, value)
    return lag_features(features, cfg, channels,
                        carry=("n", "split_n", "consumption_min", "consumption_max"))


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table in memory, spilling to disk, for the time of several passes."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _horizons(cfg: ForecastConfig, horizons: Sequence[int] | None) -> list[int]:
    return list(horizons) if horizons else list(range(1, cfg.horizon + 1))


def _side_by_side(fit: Callable[[int], Model], steps: Sequence[int], threads: int = 4) -> list:
    """Fit the steps ahead at the same time, so that small jobs fill the cluster."""
    with ThreadPool(min(threads, len(steps))) as pool:
        session = SparkSession.getActiveSession()
        return pool.map(inheritable_thread_target(session)(fit), steps)


def fit_ridges(table: DataFrame, cfg: ForecastConfig, names: Sequence[str], alphas: Sequence[float],
               horizons: Sequence[int] | None = None) -> list[PipelineModel]:
    """Ridge regressions of all steps ahead on the train rows, one model per alpha, from one pass."""
    steps = _horizons(cfg, horizons)
    products = cross_products(table.where(F.col("split") == "train"), names, steps)
    return [PipelineModel([m]) for m in linear_steps(products, names, steps, alphas)]


def fit_ridge(table: DataFrame, cfg: ForecastConfig, names: Sequence[str], alpha: float = 1.0,
              horizons: Sequence[int] | None = None) -> PipelineModel:
    """Ridge regression per step ahead on the train rows; ``alpha`` is the textbook one (Σ r² + α‖w‖²)."""
    return fit_ridges(table, cfg, names, [alpha], horizons)[0]


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the lowest validation error, and whether ``patience`` more rounds brought no lower
    one; later rounds do not count then."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_gbt(table: DataFrame, cfg: ForecastConfig, names: Sequence[str],
            trees: TreeConfig = TreeConfig(), horizons: Sequence[int] | None = None
            ) -> PipelineModel:
    """Boosted trees per step ahead with early stopping by patience.

    Every round is scored on the validation rows. Boosting ends once ``trees.patience`` rounds in a row bring
    no lower error, and the model keeps the rounds up to the lowest. MLlib cannot resume a fit, so the number of rounds
    doubles from fit to fit; with one seed a shorter fit is the beginning of a longer one.
    """
    steps = _horizons(cfg, horizons)
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    labels = [F.col("y")[h - 1].alias(f"label_{h}") for h in steps]
    data = assembler.transform(table.where(F.col("split").isin("train", "val"))).select("features", *labels, "split")
    with held(data):
        train, val = (data.where(F.col("split") == s) for s in ("train", "val"))
        checked = bool(val.take(1))

        def fit(h: int):
            regressor = GBTRegressor(
                featuresCol="features", labelCol=f"label_{h}", predictionCol=f"pred_{h}",
                maxDepth=trees.depth, stepSize=trees.rate,
                subsamplingRate=trees.subsample, minInstancesPerNode=trees.min_child,
                featureSubsetStrategy=str(trees.colsample), seed=42)
            rounds = min(trees.rounds, 2 * trees.patience) if checked else trees.rounds
            while True:
                model = regressor.setMaxIter(rounds).fit(train)
                if not checked:
                    return model
                errors = model.evaluateEachIteration(val, "squared")
                best, done = best_round(errors, trees.patience)
                if done or rounds == trees.rounds:
                    return model if best == rounds else regressor.setMaxIter(best).fit(train)
                rounds = min(trees.rounds, 2 * rounds)

        fitted = _side_by_side(fit, steps)
    return PipelineModel([assembler, *fitted])


def fit_forecaster(kind: str, table: DataFrame, cfg: ForecastConfig, names: Sequence[str],
                   horizons: Sequence[int] | None = None, **params) -> PipelineModel | list[PipelineModel]:
    """One entry point for all model kinds. ``alphas`` of a ridge give a list, one model each, from one pass."""
    if kind == "ridge":
        if "alphas" in params:
            return fit_ridges(table, cfg, names, horizons=horizons, **params)
        return fit_ridge(table, cfg, names, horizons=horizons, **params)
    if kind == "gbt":
        return fit_gbt(table, cfg, names, horizons=horizons, **params)
    raise ValueError(f"unknown model kind {kind!r}; known: {KINDS}")


def regressions(model: PipelineModel) -> list:
    """The regression stages: one for all steps, or one per step."""
    return [s for s in model.stages if isinstance(s, LinearSteps) or hasattr(s, "getPredictionCol")]


def fitted_horizons(model: PipelineModel) -> list[int]:
    """Steps ahead the model was fitted for."""
    out: list[int] = []
    for s in regressions(model):
        out += s.getOrDefault(s.steps) if isinstance(s, LinearSteps) else [
            int(s.getPredictionCol().removeprefix("pred_"))]
    return out


def predict_long(model: PipelineModel, table: DataFrame, name: str,
                 with_truth: bool = True) -> DataFrame:
    """Long predictions in original units: (series_id, model, split, origin_ts, origin_idx, h, …).

    Where the table carries the ``naive`` values of seasonal differences, they are added to prediction and
    truth, and the scaled sums limited below at 0.
    """
    return long_forecasts(model.transform(table), fitted_horizons(model), name, with_truth)


def long_forecasts(wide: DataFrame, steps: Sequence[int], name: str, with_truth: bool = True) -> DataFrame:
    """The columns ``pred_{h}`` of a scored table as the rows of :func:`predict_long`."""
    low, high = F.col("consumption_min"), F.col("consumption_max")
    differenced = "naive" in wide.columns

    def back(scaled: str) -> Column:
        return (reconstruct(F.col(scaled), F.col("_c.naive"), low, high) if differenced
                else unscale(F.col(scaled), low, high))

    cells = F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"pred_{h}").alias("p"),
                 *([F.col("y")[h - 1].alias("t")] if with_truth else []),
                 *([F.col("naive")[h - 1].alias("naive")] if differenced else [])) for h in steps])
    keep = ["series_id", "origin_ts"] + (["split", "origin_idx", "split_n"] if with_truth else [])
    rows = wide.select(*keep, low, high, F.explode(cells).alias("_c"))
    out = [*keep[:1], F.lit(name).alias("model"), *keep[1:], F.col("_c.h").alias("h"),
           back("_c.p").alias("y_pred")]
    if with_truth:
        out.append(back("_c.t").alias("y"))
    return rows.select(*out)


def latest_table(df: DataFrame, cfg: ForecastConfig, params: DataFrame,
                 channels: Sequence[str] = CHANNELS, value: str = "load") -> DataFrame:
    """Features of the last hour of each series, scaled with stored parameters."""
    features = feature_table(df, value, params=params)
    recent = features.where((F.col("n") >= cfg.history)
                            & (F.col("pos") >= F.col("n") - cfg.history))
    return lag_features(recent, cfg, channels, latest=True,
                        carry=("consumption_min", "consumption_max"))


def score_latest(bundle: dict, df: DataFrame, value: str = "load") -> DataFrame:
    """Forecast every series from its last complete window with an exported bundle.

    A missing channel or a series shorter than the history is a ValueError, found by a job
    before the plan is built. A stored bias of the validation rows is taken off.
    """
    for part in ("model", "scaler", "config"):
        if part not in bundle:
            raise KeyError(f"bundle lacks {part!r}")
    config = bundle["config"]
    cfg = ForecastConfig(history=int(config["history"]), horizon=int(config["horizon"]),
                         seasonal_diff=bool(config.get("seasonal_diff", False)))
    check_latest(df, cfg.history, ())
    table = latest_table(df, cfg, bundle["scaler"], tuple(config["channels"]), value)
    rows = predict_long(bundle["model"], table, config["model_name"], with_truth=False)
    bias = bundle.get("bias")
    if bias is None:
        return rows
    shift = bias.select("series_id", "bias")
    return rows.join(shift, "series_id", "left").withColumn(
        "y_pred", F.col("y_pred") - F.coalesce("bias", F.lit(0.0))).drop("bias")


def feature_names(cfg: ForecastConfig, channels: Sequence[str] = CHANNELS) -> list[str]:
    return lag_feature_names(cfg, channels)
