"""Scoring, bias correction, backtests and rankings of long prediction tables.

A prediction table has (series_id, model, split, origin_idx, h, y, y_pred).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores
from .residuals import flat_position, residual_diagnostics

BY_MODEL = ("series_id", "model")


def score_models(df: DataFrame, keys: Sequence[str] = BY_MODEL, y: str = "y",
                 p: str = "y_pred") -> DataFrame:
    """The seven scores and the row count per key."""
    t, q = F.col(y), F.col(p)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *scores.all_scores(t, q))


def join_predictions(truth: DataFrame, pred: DataFrame,
                     keys: Sequence[str] = ("series_id", "origin_idx", "h")) -> DataFrame:
    """Truth next to prediction, matched by key instead of by array position."""
    return truth.join(pred, list(keys))


def fit_bias(df: DataFrame, split: str = "val", keys: Sequence[str] = BY_MODEL) -> DataFrame:
    """Mean of prediction minus truth on the validation rows."""
    return (df.where(F.col("split") == split).groupBy(*keys)
            .agg(F.avg(F.col("y_pred") - F.col("y")).alias("bias")))


def subtract_bias(df: DataFrame, bias: DataFrame, keys: Sequence[str] = BY_MODEL) -> DataFrame:
    """Predictions minus the bias; models without one stay as they are.

    A key has one bias and many rows, so a task holds its biases and lets the rows pass unsorted.
    """
    return (
        df.join(bias.hint("shuffle_hash"), list(keys), "left")
        .withColumn("y_pred", F.col("y_pred") - F.coalesce("bias", F.lit(0.0))).drop("bias")
    )


def evaluate_models(df: DataFrame, horizon: int, order: str = "time", first: int | None = None) -> DataFrame:
    """Scores, residual diagnostics and the composite per (series, model).

    ``order="time"`` takes the residuals of each model's shortest step, so lag 24 is a day; ``first`` names it
    where it is the same for all, which saves a pass over the rows. ``"flat"`` reads
    all residuals in (origin, h) order, where lag 24 is the same h one origin later.
    """
    resid = df.withColumn("resid", F.col("y") - F.col("y_pred"))
    if order == "time" and first is not None:
        resid = resid.where(F.col("h") == first).withColumn("pos", F.col("origin_idx"))
    elif order == "time":
        nearest = resid.groupBy(*BY_MODEL).agg(F.min("h").alias("_first"))
        resid = resid.join(nearest, list(BY_MODEL)).where(F.col("h") == F.col("_first")).withColumn(
            "pos", F.col("origin_idx"))
    elif order == "flat":
        resid = resid.withColumn("pos", flat_position(horizon))
    else:
        raise ValueError("order must be 'time' or 'flat'")
    diagnosed = residual_diagnostics(resid, keys=BY_MODEL).select(
        *BY_MODEL, "dw", "acf_24", "acf_168", "kurtosis")
    return (
        score_models(df).join(diagnosed, list(BY_MODEL), "left")
        .withColumn("composite", scores.composite(F.col("mae"), F.col("rmse"), F.col("acf_24")))
    )


def leaderboard(scored: DataFrame, by: str = "composite") -> DataFrame:
    """Rank of each model within its series; a missing score counts as 999."""
    order = Window.partitionBy("series_id").orderBy(F.coalesce(F.col(by), F.lit(999.0)), "model")
    return scored.withColumn("rank", F.row_number().over(order))


def best_model(scored: DataFrame, by: str = "composite") -> DataFrame:
    """The model with the lowest score per series; the first name on a tie."""
    key = F.struct(F.coalesce(F.col(by), F.lit(float("inf"))), F.col("model"))
    return scored.groupBy("series_id").agg(F.min_by("model", key).alias("best_model"),
                                           F.min(by).alias("best_score"))


def backtest_block(windows: int) -> Column:
    """Block of an origin: consecutive, equal, the last one takes the remainder."""
    n, idx = F.col("n_origins"), F.col("origin_idx")
    fewer = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(n / 20)))
    k = F.when(n < windows, fewer).otherwise(F.lit(windows)).cast("bigint")
    return F.least(F.floor(idx / F.floor(n / k)), k - 1).cast("int")


def backtest(df: DataFrame, windows: int = 8, split: str = "test") -> DataFrame:
    """Scores per (series, model, block of consecutive test origins). Needs n_origins."""
    rows = df.where(F.col("split") == split).withColumn("window_no", backtest_block(windows))
    return score_models(rows, (*BY_MODEL, "window_no"))


def backtest_summary(history: DataFrame) -> DataFrame:
    """Mean and population std over the blocks."""
    out = []
    for c in ("mae", "rmse", "mape", "r2"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return history.groupBy(*BY_MODEL).agg(F.count(F.lit(1)).alias("windows"), *out)


def fit_regime(df: DataFrame, gap: float = 0.02, floor: float = 0.08) -> DataFrame:
    """over-/underfitting label from train_mae and val_mae."""
    train, val = F.col("train_mae"), F.col("val_mae")
    status = (
        F.when(train.isNull() | val.isNull(), "unknown")
        .when((val - train >= gap) & (train < floor), "overfitting")
        .when((train >= floor) & (val >= floor), "underfitting").otherwise("balanced"))
    return df.withColumns({"status": status, "generalization_gap": val - train})


def train_val_mae(df: DataFrame) -> DataFrame:
    """train_mae and val_mae per (series, model), the input of :func:`fit_regime`."""
    err = F.abs(F.col("y") - F.col("y_pred"))
    return df.groupBy(*BY_MODEL).agg(
        F.avg(F.when(F.col("split") == "train", err)).alias("train_mae"),
        F.avg(F.when(F.col("split") == "val", err)).alias("val_mae"))


def prediction_spread(df: DataFrame, sample: str = "model",
                      keys: Sequence[str] = ("series_id", "split", "origin_idx", "h")) -> DataFrame:
    """Mean and population std over repeated predictions of the same cell."""
    return df.groupBy(*keys).agg(
        F.count(sample).alias("samples"), F.avg("y_pred").alias("mean_pred"),
        F.stddev_pop("y_pred").alias("std_pred"))


def error_histogram(df: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width histogram of the errors per (series, model)."""
    from .profile import histogram
    errors = df.withColumn("err", F.col("y") - F.col("y_pred")).select(*BY_MODEL, "err")
    return histogram(errors, "err", bins, keys=BY_MODEL)
