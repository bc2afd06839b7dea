"""Calendar, tariff and covariate columns of the observation table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..config import Tariff
from ..functions import timeparts as tp


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, weekday, is_weekend, day_of_year (0-based), month, season, holiday flags."""
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t), "weekday": tp.weekday(t), "is_weekend": tp.is_weekend(t),
        "day_of_year": tp.day_of_year0(t), "month": F.month(t), "season": tp.season(t),
        "is_holiday": tp.is_holiday(t), "is_new_year": tp.is_new_year(t),
    })


def add_tariff(df: DataFrame, ts: str = "ts", use_holidays: bool = True,
               tariff: Tariff = Tariff()) -> DataFrame:
    """tariff_zone, tariff_enc, price and the peak / night flags."""
    return (
        df.withColumn("tariff_zone", tp.tariff_zone(F.col(ts), use_holidays))
        .withColumns({
            "tariff_enc": tp.zone_code(F.col("tariff_zone")),
            "price": tp.zone_price(F.col("tariff_zone"), tariff),
            "is_peak": tp.is_peak_hour(F.col("tariff_zone")),
            "is_night": tp.is_night_hour(F.col("tariff_zone")),
        })
    )


def encode_tariff(df: DataFrame) -> DataFrame:
    """tariff_enc from ``tariff_zone``, or from hour and weekday where that is missing."""
    if "tariff_zone" in df.columns:
        zone = F.col("tariff_zone")
    else:
        weekday = F.col("weekday") if "weekday" in df.columns else F.lit(0)
        zone = tp.zone_from_hour(F.col("hour"), weekday >= 5)
    return df.withColumn("tariff_enc", tp.zone_code(zone))


def add_cyclic(df: DataFrame) -> DataFrame:
    """sin / cos of hour, weekday and day of year, and the day of year in [0, 1]."""
    hour = tp.cyclic(F.col("hour"), 24)
    week = tp.cyclic(F.col("weekday"), 7)
    # The day is zero-based, so the yearly angle starts one day early; kept that way.
    year = tp.cyclic(F.col("day_of_year") - 1, 365)
    return df.withColumns({
        "hour_sin": hour[0], "hour_cos": hour[1], "dow_sin": week[0], "dow_cos": week[1],
        "month_sin": year[0], "month_cos": year[1],
        "doy_norm": F.col("day_of_year") / F.lit(364.0),
    })


def calendar_covariates(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Four covariates: hour sin / cos, weekday / 6, weekend flag."""
    t = F.col(ts)
    sin, cos = tp.cyclic(F.hour(t), 24)
    return df.withColumns({
        "cov_hour_sin": sin, "cov_hour_cos": cos,
        "cov_weekday": F.weekday(t) / F.lit(6.0),
        "cov_weekend": tp.is_weekend(t).cast("double"),
    })


def ensure_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Add the missing ones as zeros."""
    missing = {c: F.lit(0.0) for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def max_normalise(df: DataFrame, column: str, out: str) -> DataFrame:
    """x / (max + 1) per series."""
    tops = df.groupBy("series_id").agg(F.max(column).alias("_top"))
    return (df.join(tops, "series_id")
            .withColumn(out, F.col(column) / (F.col("_top") + 1.0)).drop("_top"))


def temperature_squared(df: DataFrame, column: str = "temperature",
                        train_only: bool = False) -> DataFrame:
    """T² over its maximum; from train rows and limited to [0, 1.5] with ``train_only``."""
    from ..functions.weather import clip
    square = F.col(column) * F.col(column)
    seen = F.when(F.col("split") == "train", square) if train_only else square
    tops = df.groupBy("series_id").agg((F.max(seen) + 1e-8).alias("_top"))
    ratio = square / F.col("_top")
    ratio = clip(ratio, 0.0, 1.5) if train_only else ratio
    return df.join(tops, "series_id").withColumn("temperature_sq", ratio).drop("_top")
