"""Sliding windows, targets, naive forecasts and per-window features.

An origin is the last known hour; its history is the L rows ending there and its
targets the H rows after it. Both must lie inside one split, which is a condition on
``split_pos``, so no window function is needed to find the origins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import NAIVE_WEIGHTS, PATCH_LENGTHS, ForecastConfig
from .blocks import Blocks


def is_origin(cfg: ForecastConfig) -> Column:
    """The row has a full history before it and a full horizon after it in its split."""
    return ((F.col("split_pos") >= cfg.history - 1)
            & (F.col("split_pos") + cfg.horizon < F.col("split_n")))


def origin_idx(cfg: ForecastConfig) -> Column:
    """0-based number of the origin inside its split."""
    return F.col("split_pos") - (cfg.history - 1)


def origin_count(cfg: ForecastConfig) -> Column:
    """Number of origins in the row's split: n − L − H + 1, at least 0."""
    return F.greatest(F.lit(0), F.col("split_n") - (cfg.history + cfg.horizon - 1))


def sliding_windows(df: DataFrame, cfg: ForecastConfig, channels: Sequence[str],
                    target: str = "consumption") -> DataFrame:
    """One row per origin: x = L rows of channel values, y = H targets.

    Copies every hour L times; meant for models that need the raw window. The lag
    features below avoid it.
    """
    blocks = Blocks(before=cfg.history - 1, after=cfg.horizon)
    step = F.array(*[F.col(c).cast("double") for c in channels])
    rows = blocks.spread(df).withColumns({
        "x": F.collect_list(step).over(blocks.frame(-(cfg.history - 1), 0)),
        "y": F.collect_list(F.col(target)).over(blocks.frame(1, cfg.horizon)),
    })
    return (
        blocks.core(rows).where(is_origin(cfg))
        .select("series_id", "split", F.col("ts").alias("origin_ts"),
                origin_idx(cfg).alias("origin_idx"), "x", "y")
    )


def pick_channels(windows: DataFrame, channels: Sequence[str], chosen: Sequence[str],
                  out: str = "covariates", column: str = "x") -> DataFrame:
    """Add the chosen channels of a window array as an array of their own."""
    at = [list(channels).index(c) for c in chosen]
    return windows.withColumn(out, F.transform(
        F.col(column), lambda step: F.array(*[step[i] for i in at])))


def window_counts(df: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Origins per series and split."""
    return (
        df.groupBy("series_id", "split")
        .agg(F.count(F.lit(1)).alias("n_rows"),
             F.count_if(is_origin(cfg)).alias("n_windows"))
    )


def forecast_frame(df: DataFrame, cfg: ForecastConfig, value: str = "load",
                   weekly_lag: int = 168, carry: Sequence[str] = ()) -> DataFrame:
    """Long targets with naive forecasts: one row per series, origin and h.

    The naive values belong to the target hour (the value H and ``weekly_lag`` hours
    before it), so they are looked up once per hour and only then repeated for the H
    origins that aim at the hour. They may reach across the split into the past.
    ``weekly_lag=cfg.history`` gives the variant whose second lag is the window length.
    """
    blocks = Blocks(before=max(cfg.horizon, weekly_lag))
    ordered = blocks.window()
    zero = F.lit(0.0)
    a, b = NAIVE_WEIGHTS
    rows = blocks.spread(df).withColumns({
        "naive_24": F.greatest(F.lag(value, cfg.horizon).over(ordered), zero),
        "_weekly": F.lag(value, weekly_lag).over(ordered),
    })
    rows = blocks.core(rows).withColumns({
        "naive_168": F.greatest(F.coalesce("_weekly", "naive_24"), zero),
        "y": F.col(value),
        "h": F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))),
    })
    start = F.col("split_pos") - F.col("h")
    return (
        rows.where((start >= cfg.history - 1) & (start + cfg.horizon < F.col("split_n")))
        .select(
            "series_id", "split", "ts", "pos", "h",
            (start - (cfg.history - 1)).alias("origin_idx"),
            origin_count(cfg).alias("n_origins"),
            "y", "naive_24", "naive_168",
            F.when(F.col("_weekly").isNull(), F.col("naive_24"))
            .otherwise(a * F.col("naive_24") + b * F.col("naive_168")).alias("naive_dual"),
            *carry)
    )


def to_long(frame: DataFrame, models: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Prediction columns to rows: (…keep, model, y_pred)."""
    pairs = [F.struct(F.lit(name).alias("model"), F.col(c).alias("y_pred"))
             for name, c in models.items()]
    return (frame.select(*keep, F.explode(F.array(*pairs)).alias("_m"))
            .select(*keep, "_m.model", "_m.y_pred"))


NAIVES = {"naive_24": "naive_24", "naive_168": "naive_168", "naive_dual": "naive_dual"}


def single_origin_view(frame: DataFrame, cfg: ForecastConfig, parity_rows: int | None = None
                       ) -> DataFrame:
    """Consecutive non-overlapping horizons; ``parity_rows=k`` keeps origins 0..k-1 instead."""
    if parity_rows is not None:
        return frame.where(F.col("origin_idx") < parity_rows)
    return frame.where(F.col("origin_idx") % cfg.horizon == 0)


def walk_forward_view(frame: DataFrame) -> DataFrame:
    """One step ahead from every origin."""
    return frame.where(F.col("h") == 1)


WEEK = 168


def _seasonal_naive(blocks: Blocks, cfg: ForecastConfig, load: str) -> Column:
    """Array of the naive forecasts of an origin's steps, from the window that ends there."""
    def shifted(back: int) -> Column:
        rows = F.collect_list(F.struct(F.col(load).alias("v"))).over(blocks.frame(1 - back, cfg.horizon - back))
        return F.transform(rows, lambda s: F.greatest(s["v"], F.lit(0.0)))

    daily = shifted(cfg.horizon)
    if cfg.history < WEEK:
        return daily
    a, b = NAIVE_WEIGHTS
    return F.zip_with(daily, shifted(cfg.history), lambda day, far: a * day + b * far)


def lag_features(df: DataFrame, cfg: ForecastConfig, channels: Sequence[str],
                 load: str = "consumption", raw_lags: bool = True,
                 carry: Sequence[str] = (), latest: bool = False) -> DataFrame:
    """Flat per-origin features from window aggregates; the window itself is never built.

    For history T and F channels: T raw lags, 13 load statistics, the last value of the
    F-1 other channels, and six rolling statistics of every channel; T + 13 + (F-1) + 6F.
    Standard deviations are population ones. Frames longer than T are cut to T.
    ``latest`` gives the last row of each series instead of the origins with targets.

    With ``cfg.seasonal_diff`` the targets are differences to the seasonal naive forecast, which the array
    ``naive`` carries: the value ``horizon`` hours before the target, from a history of a week on mixed with
    the value ``history`` hours before it. A negative naive value counts as 0.
    """
    t = cfg.history
    if cfg.seasonal_diff and t < cfg.horizon:
        raise ValueError("seasonal differences need a history no shorter than the horizon")
    blocks = Blocks(before=t, after=cfg.horizon)
    ordered = blocks.window()
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def frame(width: int):
        return blocks.frame(-(min(width, t) - 1), 0)

    def mean(c: str, width: int) -> Column:
        # Difference of the block's running sum: the cost does not grow with the width.
        width = min(width, t)
        before = F.coalesce(F.lag(f"_sum_{c}", width).over(ordered), F.lit(0.0))
        return (F.col(f"_sum_{c}") - before) / float(width)

    def back(k: int) -> Column:
        return F.lag(load, k).over(ordered) if k else F.col(load)

    x = F.col(load)
    new: dict[str, Column] = {}
    if raw_lags:
        for k in range(t - 1, -1, -1):
            new[f"load_t{k}"] = back(k)
    for width in (3, 6, 12, 24):
        new[f"load_mean{width}"] = mean(load, width)
    for width in (6, 24):
        new[f"load_std{width}"] = F.stddev_pop(load).over(frame(width))
    low, high = F.min(load).over(frame(24)), F.max(load).over(frame(24))
    new["load_min24"], new["load_max24"], new["load_range24"] = low, high, high - low
    new["load_d1"] = x - back(1) if t >= 2 else F.lit(0.0)
    new["load_d3"] = x - back(3) if t >= 4 else F.lit(0.0)
    new["load_d24"] = x - back(24) if t >= 25 else F.lit(0.0)
    new["load_ratio24"] = x / (back(24) + 1e-8) if t >= 25 else F.lit(1.0)
    for c in channels:
        if c != load:
            new[f"{c}_last"] = F.col(c)
    for width in (6, 12, 24, 48):
        for c in channels:
            new[f"{c}_rm{width}"] = mean(c, width)
    for width in (6, 24):
        for c in channels:
            new[f"{c}_rs{width}"] = F.stddev_pop(c).over(frame(width))
    names = list(new)
    if cfg.seasonal_diff:
        new["naive"] = _seasonal_naive(blocks, cfg, load)
        carry = (*carry, "naive")
    summed = blocks.spread(df).withColumns(
        {f"_sum_{c}": F.sum(c).over(upto) for c in dict.fromkeys((load, *channels))})
    if latest:
        rows = blocks.core(summed.withColumns(new)).where(
            F.col("pos") == F.col("n") - 1)
        return rows.select("series_id", F.col("ts").alias("origin_ts"), *names, *carry)
    new["y"] = F.collect_list(load).over(blocks.frame(1, cfg.horizon))
    rows = blocks.core(summed.withColumns(new)).where(is_origin(cfg))
    if cfg.seasonal_diff:
        rows = rows.withColumn("y", F.zip_with("y", "naive", lambda y, naive: y - naive))
    return rows.select("series_id", "split", F.col("ts").alias("origin_ts"), "pos",
                       origin_idx(cfg).alias("origin_idx"), *names, "y", *carry)


def lag_feature_names(cfg: ForecastConfig, channels: Sequence[str],
                      load: str = "consumption", raw_lags: bool = True) -> list[str]:
    """Feature columns of :func:`lag_features`, in order."""
    names = [f"load_t{k}" for k in range(cfg.history - 1, -1, -1)] if raw_lags else []
    names += [f"load_mean{w}" for w in (3, 6, 12, 24)] + [f"load_std{w}" for w in (6, 24)]
    names += ["load_min24", "load_max24", "load_range24",
              "load_d1", "load_d3", "load_d24", "load_ratio24"]
    names += [f"{c}_last" for c in channels if c != load]
    names += [f"{c}_rm{w}" for w in (6, 12, 24, 48) for c in channels]
    names += [f"{c}_rs{w}" for w in (6, 24) for c in channels]
    return names


def patches(windows: DataFrame, length: int, stride: int, history: int,
            column: str = "hist") -> DataFrame:
    """Add ``patches``: overlapping slices of a window array, ⌊(L−P)/S⌋+1 of them."""
    starts = F.sequence(F.lit(1), F.lit(history - length + 1), F.lit(stride))
    return windows.withColumn(
        "patches", F.transform(starts, lambda i: F.slice(F.col(column), i, length)))


def patch_geometry(history: int) -> tuple[int, int]:
    """(length, stride) for a history length."""
    length = next(size for least, size in PATCH_LENGTHS if history >= least)
    return length, length // 2


def load_history(df: DataFrame, cfg: ForecastConfig, value: str = "load") -> DataFrame:
    """One row per origin with ``hist``, the L loads ending there."""
    blocks = Blocks(before=cfg.history - 1)
    rows = blocks.spread(df).withColumn(
        "hist", F.collect_list(value).over(blocks.frame(-(cfg.history - 1), 0)))
    return (blocks.core(rows).where(is_origin(cfg))
            .select("series_id", "split", F.col("ts").alias("origin_ts"),
                    origin_idx(cfg).alias("origin_idx"), "hist"))


def instance_norm(df: DataFrame, cfg: ForecastConfig, value: str = "load",
                  eps: float = 1e-6) -> DataFrame:
    """Per-origin mean and population std of the history, and the scaled last value."""
    blocks = Blocks(before=cfg.history - 1)
    frame = blocks.frame(-(cfg.history - 1), 0)
    rows = blocks.core(blocks.spread(df).withColumns({
        "win_mean": F.avg(value).over(frame),
        "win_std": F.stddev_pop(value).over(frame),
    })).where(is_origin(cfg))
    return rows.withColumn("normed", (F.col(value) - F.col("win_mean"))
                           / (F.col("win_std") + eps))


def denormalise(normed: Column, mean: Column, std: Column, eps: float = 1e-6) -> Column:
    """Inverse of the per-window scaling."""
    return normed * (std + eps) + mean


def latest_window(df: DataFrame, history: int, channels: Sequence[str]) -> DataFrame:
    """The last ``history`` rows of each series as one array; at most that many per task.

    Series with fewer rows are left out here; :func:`check_latest` raises for them.
    """
    step = F.struct(F.col("pos"), F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))
    return (
        df.where((F.col("n") >= history) & (F.col("pos") >= F.col("n") - history))
        .groupBy("series_id")
        .agg(F.max("ts").alias("origin_ts"), F.sort_array(F.collect_list(step)).alias("_w"))
        .select("series_id", "origin_ts", F.transform("_w", lambda s: s["v"]).alias("x"))
    )


def check_latest(df: DataFrame, history: int, channels: Sequence[str]) -> None:
    """ValueError when a channel is missing or a series is shorter than the history."""
    missing = [c for c in channels if c not in df.columns]
    if missing:
        raise ValueError(f"window lacks channels {missing}")
    short = df.where(F.col("n") < history).select("series_id").limit(1).collect()
    if short:
        raise ValueError(f"series {short[0][0]} has fewer than {history} rows")
