"""Lag and rolling columns, scaling, and the 26-channel feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CHANNELS, LAGS
from ..functions.weather import clip
from .blocks import BLOCK, Blocks
from .calendar import add_calendar, add_cyclic, add_tariff, ensure_columns

ROLLING = 24


def add_lags_and_rolling(df: DataFrame, value: str = "load", lags: Sequence[int] = LAGS,
                         rolling: bool = True, block_rows: int | None = None) -> DataFrame:
    """load_lag_{k}h, and rolling_mean_24h / rolling_std_24h restarted in each split.

    The first k rows of a lag take the first value of the series; a series no longer
    than k takes its median. Lags are read across splits, rolling statistics are not.
    One shuffle serves both: the split only refines the block's partitioning.
    """
    reach = max(lags)
    blocks = Blocks(before=reach, **({"rows": block_rows} if block_rows else {}))
    rows = blocks.spread(df)
    ordered = blocks.window()
    # Blocks are longer than the reach, so a row in want of the first value lies in block 0,
    # and a series short enough to want its median lies in block 0 as a whole.
    first = F.first(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    short = F.when(F.col("n") <= reach, F.col(value))
    median = F.median(short).over(Window.partitionBy(*blocks.keys, BLOCK))
    new = {}
    for k in lags:
        fill = F.when(F.col("n") > k, first).otherwise(median)
        new[f"load_lag_{k}h"] = F.coalesce(F.lag(value, k).over(ordered), fill)
    if rolling:
        frame = blocks.frame(-(ROLLING - 1), 0, "split")
        new["rolling_mean_24h"] = F.avg(value).over(frame)
        new["rolling_std_24h"] = F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))
    return blocks.core(rows.withColumns(new))


def fit_minmax(df: DataFrame, columns: Sequence[str], split: str | None = "train") -> DataFrame:
    """Scaler parameters per series: {column}_min and {column}_max over the train rows."""
    aggs = []
    for c in columns:
        seen = F.when(F.col("split") == split, F.col(c)) if split else F.col(c)
        aggs += [F.min(seen).alias(f"{c}_min"), F.max(seen).alias(f"{c}_max")]
    return df.groupBy("series_id").agg(*aggs)


def scale(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling, not clipped; a zero range counts as 1."""
    return (x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def unscale(x: Column, low: Column, high: Column) -> Column:
    """Inverse of :func:`scale`."""
    return x * F.when(high == low, F.lit(1.0)).otherwise(high - low) + low


def reconstruct(diff: Column, naive: Column, low: Column, high: Column) -> Column:
    """Seasonal difference plus naive, limited below at 0, back in original units."""
    return unscale(F.greatest(diff + naive, F.lit(0.0)), low, high)


SCALED = ("consumption", "temperature", "humidity", "wind_speed", "rolling_std_24h", "cloud_cover")


def scaler_params(df: DataFrame, value: str = "load") -> DataFrame:
    """Train-split scaler parameters of :func:`feature_table`, one row per series."""
    return fit_minmax(_prepared(df, value), (*SCALED, "_t2"))


def _prepared(df: DataFrame, value: str) -> DataFrame:
    base = ensure_columns(
        df.withColumnRenamed(value, "consumption"),
        ("temperature", "humidity", "wind_speed", "cloud_cover", "ev_load_norm",
         "solar_gen_norm", "dsr_active"))
    base = add_lags_and_rolling(base, "consumption")
    return base.withColumn("_t2", F.col("temperature") * F.col("temperature"))


def feature_table(df: DataFrame, value: str = "load", use_holidays: bool = True,
                  keep: Sequence[str] = ("n", "split", "split_pos", "split_n"),
                  params: DataFrame | None = None) -> DataFrame:
    """The 26 channels in fixed order, after (series_id, ts, pos) and ``keep``.

    Needs (series_id, ts, pos, n, split) and the load; absent weather and device
    columns count as zeros. Scalers are fitted on the train rows of each series, or
    taken from ``params``.
    Also carries consumption_min / consumption_max for the way back.
    """
    base = _prepared(df, value)
    if params is None:
        params = fit_minmax(base, (*SCALED, "_t2"))
    rows = add_cyclic(add_tariff(add_calendar(base), use_holidays=use_holidays))
    rows = rows.join(params, "series_id")

    def scaled(column: str, by: str | None = None) -> Column:
        by = by or column
        return scale(F.col(column), F.col(f"{by}_min"), F.col(f"{by}_max"))

    channel = {
        "consumption": scaled("consumption"),
        "temperature": scaled("temperature"),
        "temperature_sq": clip(F.col("_t2") / (F.col("_t2_max") + 1e-8), 0.0, 1.5),
        "humidity": scaled("humidity"),
        "wind_speed": scaled("wind_speed"),
        "rolling_mean_24h": clip(scaled("rolling_mean_24h", "consumption"), 0.0, 1.0),
        "rolling_std_24h": clip(scaled("rolling_std_24h"), 0.0, 1.0),
        "cloud_cover": clip(scaled("cloud_cover"), 0.0, 1.0),
    }
    for k in LAGS:
        channel[f"lag_{k}h"] = clip(scaled(f"load_lag_{k}h", "consumption"), 0.0, 1.5)
    for c in ("ev_load_norm", "solar_gen_norm", "dsr_active"):
        channel[c] = clip(F.col(c), 0.0, 1.0)
    return rows.select(
        "series_id", "ts", "pos", *keep,
        *[channel.get(c, F.col(c)).cast("double").alias(c) for c in CHANNELS],
        "consumption_min", "consumption_max")
