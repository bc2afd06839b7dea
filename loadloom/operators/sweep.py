"""Parameter search, history-length sweep and model comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, functions as F

from ..config import CHANNELS, ForecastConfig
from ..session import cut_lineage
from ..sources.tables import write_results_csv
from .ensemble import search_weights, side_by_side, weighted_by_series
from .evaluate import evaluate_models
from .models import KINDS, feature_names, fit_forecaster, held, model_table, predict_long, regressions
from .windows import NAIVES, forecast_frame, to_long


def model_size(model: PipelineModel) -> int:
    """Coefficients of linear stages plus nodes of tree stages."""
    total = 0
    for stage in regressions(model):
        total += stage.totalNumNodes if hasattr(stage, "totalNumNodes") else stage.size
    return total


def grid_search(kind: str, table: DataFrame, cfg: ForecastConfig, names: Sequence[str],
                grid: Sequence[dict], horizons: Sequence[int] | None = None,
                target_size: int | None = None) -> tuple[DataFrame, dict]:
    """Fit each parameter set on train, score it on the chronological validation split.

    Returns the sweep table (params, val_mae, size, used) and the best parameters. With
    ``target_size`` models more than 50 % off that size do not take part. All alphas of a ridge come from
    one pass over the train rows.
    """
    rows, best = [], (float("inf"), {})
    with held(table):
        shared = iter(fit_forecaster(kind, table, cfg, names, horizons=horizons, alphas=[p["alpha"] for p in grid])
                      if kind == "ridge" and grid and all(set(p) == {"alpha"} for p in grid) else ())
        for params in grid:
            model = next(shared, None) or fit_forecaster(kind, table, cfg, names, horizons=horizons, **params)
            size = model_size(model)
            used = target_size is None or abs(size - target_size) / target_size <= 0.5
            error = None
            if used:
                val = predict_long(model, table.where(F.col("split") == "val"), kind)
                error = val.agg(F.avg(F.abs(F.col("y") - F.col("y_pred")))).first()[0]
                if error is not None and error < best[0]:
                    best = (error, dict(params))
            rows.append(Row(params=str(params), val_mae=error, size=size, used=used))
    schema = "params string, val_mae double, size bigint, used boolean"
    return table.sparkSession.createDataFrame(rows, schema), best[1]


def best_parameters(sweep: DataFrame) -> DataFrame:
    """The row of a sweep table with the lowest validation error."""
    return sweep.where("used").agg(
        F.min_by("params", F.struct("val_mae", "params")).alias("params"),
        F.min("val_mae").alias("val_mae"))


def naive_predictions(df: DataFrame, cfg: ForecastConfig, value: str = "load") -> DataFrame:
    """Long predictions of the three seasonal-naive models."""
    frame = forecast_frame(df, cfg, value)
    return to_long(frame, NAIVES, ("series_id", "split", "origin_idx", "n_origins", "h", "y"))


LONG = ("series_id", "model", "split", "origin_idx", "h", "y", "y_pred")


def compare_models(df: DataFrame, cfg: ForecastConfig, kinds: Sequence[str] = ("naive", "ridge"),
                   channels: Sequence[str] = CHANNELS, horizons: Sequence[int] | None = None,
                   split: str = "test", params: dict[str, dict] | None = None) -> DataFrame:
    """All model kinds under equal conditions: one scored row per (series, model).

    ``"ensemble"`` blends all other models with the weights that validation rows favour; it is
    scored like the rest. The search runs jobs while the plan is built.
    """
    parts = []
    if "naive" in kinds:
        parts.append(naive_predictions(df, cfg).select(*LONG))
    fitted = [k for k in kinds if k in KINDS]
    if fitted:
        table = model_table(df, cfg, channels)
        with held(table):
            for kind in fitted:
                model = fit_forecaster(kind, table, cfg, feature_names(cfg, channels),
                                       horizons=horizons, **(params or {}).get(kind, {}))
                parts.append(predict_long(model, table, kind).select(*LONG))
    rows = reduce(DataFrame.unionByName, parts)
    if horizons:
        rows = rows.where(F.col("h").isin(list(horizons)))
    if "ensemble" in kinds:
        members = [*(NAIVES if "naive" in kinds else ()), *fitted]
        rows = cut_lineage(rows)
        wide = cut_lineage(side_by_side(rows, members))
        blend = weighted_by_series(wide, search_weights(wide, members), members)
        rows = rows.unionByName(blend.withColumn("model", F.lit("ensemble")).select(*LONG))
    return evaluate_models(rows.where(F.col("split") == split), cfg.horizon, first=min(horizons or (1,)))


def history_sweep(df: DataFrame, cfg: ForecastConfig, histories: Sequence[int] = (24, 48, 72, 96),
                  path: str | None = None, **options) -> DataFrame:
    """:func:`compare_models` for several history lengths, one table; CSV with ``path``."""
    parts = [compare_models(df, replace(cfg, history=length), **options)
             .withColumn("history", F.lit(length)) for length in histories]
    out = reduce(DataFrame.unionByName, parts)
    if path:
        write_results_csv(out, path)
    return out


def sweep_summary(results: DataFrame) -> DataFrame:
    """Mean scores per model over all series, best first."""
    return (
        results.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.avg("mae").alias("mae"),
                                     F.avg("rmse").alias("rmse"),
                                     F.avg("composite").alias("composite"))
        .orderBy(F.coalesce("composite", F.lit(999.0)), "model")
    )
