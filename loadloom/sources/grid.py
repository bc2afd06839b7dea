"""Raw events to a complete hourly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeparts import hour_index
from .runs import dense, hour_runs


def hourly_grid(events: DataFrame, series: str | Column, ts: str = "ts", value: str = "value",
                span: str = "global") -> DataFrame:
    """One row per series and hour: (series_id, ts, pos, n, load, n_obs).

    ``load`` is the sum of ``value`` in the hour, 0 where nothing happened; ``pos``
    counts hours from the start of the span and ``n`` is its length. ``span="global"``
    gives all series the same first and last hour, ``"series"`` each its own.

    The rows are those of the runs of :func:`hour_runs`: a busy hour gives itself and the empty hours up to the next
    one, where it lies. The empty cells, by far the most rows, are made last, in as many tasks as the session's
    shuffles have, and pass no shuffle and no aggregation here, so no task holds them. Rows without a series or time have no cell.
    """
    return dense(hour_runs(events, series, ts, value, span))


def with_positions(hourly: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``pos`` and ``n`` to an hourly table that is already complete."""
    ends = hourly.groupBy("series_id").agg(
        F.min(hour_index(F.col(ts))).alias("_lo"), F.max(hour_index(F.col(ts))).alias("_hi"))
    return (
        hourly.join(ends, "series_id")
        .withColumn("pos", hour_index(F.col(ts)) - F.col("_lo"))
        .withColumn("n", F.col("_hi") - F.col("_lo") + 1)
        .drop("_lo", "_hi")
    )


def with_split(df: DataFrame, train_pct: int = 70, val_pct: int = 15) -> DataFrame:
    """Chronological train / val / test by position, with the place inside the split.

    Adds ``split``, ``split_pos`` (0-based) and ``split_n``. Integer arithmetic on
    (pos, n): no window and no shuffle.
    """
    a = F.expr(f"(n * {train_pct}) div 100")
    b = F.expr(f"(n * {train_pct + val_pct}) div 100")
    pos, n = F.col("pos"), F.col("n")
    return (
        df.withColumn("split", F.when(pos < a, "train").when(pos < b, "val").otherwise("test"))
        .withColumn("split_pos", F.when(pos < a, pos).when(pos < b, pos - a).otherwise(pos - b))
        .withColumn("split_n", F.when(pos < a, a).when(pos < b, b - a).otherwise(n - b))
    )


def head(df: DataFrame, rows: int, pos: str = "pos") -> DataFrame:
    """First rows of each series by position (first day, week, month, horizon)."""
    return df.where(F.col(pos) < rows)
