"""Additive seasonal decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .blocks import Blocks


def seasonal_decompose(df: DataFrame, value: str = "load", period: int = 24,
                       max_rows: int | None = None) -> DataFrame:
    """trend, seasonal, resid per row; of all hours, or the first ``max_rows``.

    The trend is the centred moving average over period + 1 rows with half weights at
    the ends, NULL where the frame is cut; the seasonal part is the mean detrended value
    of each phase, centred at zero. ``period`` must be even.
    """
    if period % 2:
        raise ValueError("period must be even")
    half = period // 2
    rows = df.where(F.col("pos") < max_rows) if max_rows else df
    blocks = Blocks(before=half, after=half)
    ordered = blocks.window()
    full = blocks.frame(-half, half)
    x = F.col(value)
    ends = (F.lag(value, half).over(ordered) + F.lead(value, half).over(ordered)) / 2.0
    trend = F.when(F.count(value).over(full) == period + 1,
                   (F.sum(value).over(full) - ends) / period)
    rows = blocks.core(blocks.spread(rows).withColumn("trend", trend)).withColumn(
        "phase", (F.col("pos") % period).cast("int"))
    phases = rows.groupBy("series_id", "phase").agg(F.avg(x - F.col("trend")).alias("_raw"))
    centres = phases.groupBy("series_id").agg(F.avg("_raw").alias("_centre"))
    seasonal = phases.join(centres, "series_id").select(
        "series_id", "phase", (F.col("_raw") - F.col("_centre")).alias("seasonal"))
    return (
        rows.join(seasonal, ["series_id", "phase"])
        .withColumn("resid", x - F.col("trend") - F.col("seasonal"))
    )
