"""Descriptive profiles of the load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import adjusted_kurtosis, adjusted_skew
from .blocks import exact_quantiles


def describe(df: DataFrame, value: str = "load") -> DataFrame:
    """count, mean, std (sample), min, quartiles, max per series."""
    x = F.col(value)
    basic = df.groupBy("series_id").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = exact_quantiles(df, value, {"q25": 0.25, "q50": 0.50, "q75": 0.75})
    return basic.join(quartiles, "series_id", "left")


def moments(df: DataFrame, value: str = "load") -> DataFrame:
    """Coefficient of variation, bias-adjusted skewness and excess kurtosis per series."""
    x = F.col(value)
    n = F.col("n").cast("double")
    return (
        df.groupBy("series_id").agg(
            F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"),
            F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
        .select("series_id", "n", (F.col("_s") / F.col("_m")).alias("cv"),
                adjusted_skew(F.col("_g1"), n).alias("skew"),
                adjusted_kurtosis(F.col("_g2"), n).alias("kurt"))
    )


def hour_profile(df: DataFrame, value: str = "load", ts: str = "ts") -> DataFrame:
    return df.groupBy("series_id", F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean_load"))


def weekday_profile(df: DataFrame, value: str = "load", ts: str = "ts") -> DataFrame:
    return (df.groupBy("series_id", F.weekday(ts).alias("weekday"))
            .agg(F.avg(value).alias("mean_load")))


def hour_weekday_pivot(df: DataFrame, value: str = "load", ts: str = "ts") -> DataFrame:
    """Mean load by hour, one column per weekday (wd0 = Monday)."""
    day = F.weekday(ts)
    columns = [F.avg(F.when(day == d, F.col(value))).alias(f"wd{d}") for d in range(7)]
    return df.groupBy("series_id", F.hour(ts).alias("hour")).agg(*columns)


def _with_range(df: DataFrame, column: str, prefix: str,
                keys: Sequence[str] = ("series_id",)) -> DataFrame:
    ends = df.groupBy(*keys).agg(F.min(column).alias(f"{prefix}_lo"),
                                 F.max(column).alias(f"{prefix}_hi"))
    return df.join(ends, list(keys))


def left_closed_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, left-closed, the last one closed on both sides."""
    width = (high - low) / bins
    return F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((x - low) / width), F.lit(bins - 1))).cast("int")


def right_closed_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based equal-width bin, right-closed, the first one includes the minimum."""
    width = (high - low) / bins
    return F.when(high == low, F.lit(1)).otherwise(
        F.least(F.greatest(F.lit(1), F.ceil((x - low) / width)), F.lit(bins))).cast("int")


def histogram(df: DataFrame, value: str = "load", bins: int = 60,
              keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Counts and density in equal-width bins per key; empty bins are left out."""
    x = F.col(value)
    rows = _with_range(df.where(x.isNotNull()), value, "_x", keys)
    width = (F.col("_x_hi") - F.col("_x_lo")) / bins
    binned = rows.groupBy(*keys, left_closed_bin(x, F.col("_x_lo"), F.col("_x_hi"), bins)
                          .alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_x_lo").alias("_x_lo"),
        F.first(width).alias("_w"))
    sizes = binned.groupBy(*keys).agg(F.sum("count").alias("_n"))
    return binned.join(sizes, list(keys)).select(
        *keys, "bin", (F.col("_x_lo") + F.col("bin") * F.col("_w")).alias("bin_left"),
        "count",
        F.when(F.col("_w") > 0, F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"))


def centre(df: DataFrame, value: str = "load") -> DataFrame:
    """Mean and median per series, the two marks of the histogram."""
    mean = df.groupBy("series_id").agg(F.avg(value).alias("mean"))
    return mean.join(exact_quantiles(df, value, {"median": 0.5}), "series_id", "left")


def value_bins(df: DataFrame, by: str, value: str = "load", bins: int = 36) -> DataFrame:
    """Median, P10 and P90 of the load in equal-width, right-closed bins of another column."""
    low, high = F.col("_b_lo"), F.col("_b_hi")
    rows = _with_range(df, by, "_b").withColumn(
        "bin", right_closed_bin(F.col(by), low, high, bins))
    keys = ["series_id", "bin"]
    mids = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.first(low + (F.col("bin") - 0.5) * (high - low) / bins).alias("mid"))
    quantiles = exact_quantiles(rows, value, {"p10": 0.10, "median": 0.50, "p90": 0.90}, keys)
    return mids.join(quantiles, keys, "left")


def density_2d(df: DataFrame, by: str, value: str = "load", bins: int = 40) -> DataFrame:
    """Row counts on a square grid over (by, value); empty cells are left out."""
    rows = _with_range(_with_range(df, by, "_b"), value, "_x")
    return rows.groupBy(
        "series_id",
        left_closed_bin(F.col(by), F.col("_b_lo"), F.col("_b_hi"), bins).alias("bin_x"),
        left_closed_bin(F.col(value), F.col("_x_lo"), F.col("_x_hi"), bins).alias("bin_y"),
    ).agg(F.count(F.lit(1)).alias("count"))
