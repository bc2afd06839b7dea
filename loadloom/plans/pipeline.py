"""The three end-to-end runs: full pipeline, model comparison, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import CHANNELS, Battery, ForecastConfig
from ..operators import ensemble, evaluate, models, profile, quality, residuals, storage, sweep
from ..sources.bundle import export_bundle, load_bundle
from ..sources.grid import with_split
from ..operators.features import scaler_params
from ..session import cut_lineage


def run_pipeline(hourly: DataFrame, cfg: ForecastConfig, battery: Battery,
                 kinds: Sequence[str] = ("ridge",), horizons: Sequence[int] | None = None,
                 channels: Sequence[str] = CHANNELS, bundle_path: str | None = None,
                 params: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Check, profile, forecast, score, blend, test and price; one table per result.

    ``hourly`` is a complete grid with (series_id, ts, pos, n, load). It is written to
    the shared folder once, because every stage reads it.
    """
    grid = cut_lineage(with_split(hourly, cfg.train_pct, cfg.val_pct))
    out = {
        "quality": quality.quality_report(grid),
        "describe": profile.describe(grid),
        "drift": quality.drift_check(grid),
    }
    steps = list(horizons) if horizons else list(range(1, cfg.horizon + 1))
    # All models are scored on the same steps ahead.
    naive = sweep.naive_predictions(grid, cfg).where(F.col("h").isin(steps))
    predictions = [naive.select(*sweep.LONG, "n_origins")]
    table = models.model_table(grid, cfg, channels)
    names = models.feature_names(cfg, channels)
    with models.held(table):
        for kind in kinds:
            model = models.fit_forecaster(kind, table, cfg, names, horizons=horizons,
                                          **(params or {}).get(kind, {}))
            rows = models.predict_long(model, table, kind)
            predictions.append(rows.withColumn(
                "n_origins", F.col("split_n") - (cfg.history + cfg.horizon - 1)
            ).select(*sweep.LONG, "n_origins"))
            if bundle_path:
                export_bundle(model, scaler_params(grid), {
                    "model_name": kind, "history": cfg.history, "horizon": cfg.horizon,
                    "channels": list(channels), "seasonal_diff": cfg.seasonal_diff}, f"{bundle_path}/{kind}", evaluate.fit_bias(rows))
        # Every later stage reads the predictions; they are written once.
        long = cut_lineage(reduce(DataFrame.unionByName, predictions))
    # The blend of all models is one more model: weights from validation rows, scores on test.
    members = sorted(kinds) + ["naive_24", "naive_168", "naive_dual"]
    wide = cut_lineage(ensemble.side_by_side(long, members))
    weights = ensemble.search_weights(wide, members)
    blend = ensemble.weighted_by_series(wide, weights, members).withColumn("model", F.lit("ensemble"))
    long = long.unionByName(blend.select(*long.columns))
    bias = evaluate.fit_bias(long)
    corrected = evaluate.subtract_bias(long, bias)
    test = corrected.where(F.col("split") == "test")
    scored = evaluate.evaluate_models(test, cfg.horizon)
    blocks = evaluate.backtest(corrected, cfg.backtest_windows)
    resid = (test.where(F.col("h") == min(steps))
             .select("series_id", "model", F.col("origin_idx").alias("pos"),
                     (F.col("y") - F.col("y_pred")).alias("resid")))
    out |= {
        "predictions": corrected, "bias": bias,
        "leaderboard": evaluate.leaderboard(scored),
        "best_model": evaluate.best_model(scored),
        "regime": evaluate.fit_regime(evaluate.train_val_mae(long)),
        "backtest": blocks, "backtest_summary": evaluate.backtest_summary(blocks),
        "residual_tests": residuals.residual_tests(resid, keys=evaluate.BY_MODEL),
        "weights": weights,
        "storage": storage.compare_strategies(
            grid.where(F.col("split") == "test").withColumn("pos", F.col("split_pos")), battery),
    }
    return out


def run_comparison(hourly: DataFrame, cfg: ForecastConfig, path: str | None = None, **options
                   ) -> dict[str, DataFrame]:
    """History sweep and its per-model summary; results as CSV below ``path``."""
    grid = cut_lineage(with_split(hourly, cfg.train_pct, cfg.val_pct))
    results = sweep.history_sweep(grid, cfg, path=path, **options)
    return {"results": results, "summary": sweep.sweep_summary(results)}


def run_scoring(hourly: DataFrame, bundle_path: str) -> DataFrame:
    """Forecast the hours after the end of every series with a stored bundle."""
    return models.score_latest(load_bundle(hourly.sparkSession, bundle_path), with_split(hourly))
