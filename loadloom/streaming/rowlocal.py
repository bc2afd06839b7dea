"""Row-local operators on streaming DataFrames.

Calendar, tariff, encoding and scaling columns look at one row at a time, so the same
functions take a stream. Nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.calendar import add_calendar, add_cyclic, add_tariff
from ..operators.features import scale


def enrich_stream(stream: DataFrame, ts: str = "ts", use_holidays: bool = True) -> DataFrame:
    """Calendar, tariff and cyclic columns on a stream (or a table)."""
    named = stream if ts == "ts" else stream.withColumn("ts", F.col(ts))
    return add_cyclic(add_tariff(add_calendar(named), use_holidays=use_holidays))


def scale_stream(stream: DataFrame, params: DataFrame, column: str) -> DataFrame:
    """Scale a stream with stored per-series parameters (stream–static join)."""
    low, high = f"{column}_min", f"{column}_max"
    known = params.select("series_id", low, high)
    return (stream.join(known, "series_id", "left")
            .withColumn(f"{column}_scaled", scale(F.col(column), F.col(low), F.col(high)))
            .drop(low, high))
