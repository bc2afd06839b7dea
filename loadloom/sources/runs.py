"""The hourly grid in runs: busy hours one by one, empty hours as (start, length).

A grid has series x hours rows however little happens. Its runs have at most two rows per busy
hour and one more per series, so they grow with the events. ``operators/sparse.py`` computes on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeparts import hour_index, hour_start
from ..operators.blocks import BLOCK_ROWS


def hour_runs(events: DataFrame, series: str | Column, ts: str = "ts", value: str = "value",
              span: str = "global", block_hours: int = BLOCK_ROWS) -> DataFrame:
    """(series_id, start, length, n, lo, load, n_obs): the runs of each series, without gap or overlap.

    ``start`` counts hours from the first hour ``lo`` of the span (an hour index) and ``n`` is the span's length, as
    ``pos`` and ``n`` do in :func:`hourly_grid`. A busy hour has length 1 and ``n_obs`` > 0; an empty run has load 0 and
    ``n_obs`` 0. A busy hour whose values are all NULL has load 0. Rows without a series or time have no cell.

    The hour after each one is found inside blocks of ``block_hours`` hours; what follows a block comes
    from the first hours of the blocks, so no task holds all hours of a series.
    """
    key = F.col(series) if isinstance(series, str) else series
    raw = events.select(key.cast("string").alias("series_id"), hour_index(F.col(ts)).alias("hr"),
                        F.col(value).cast("double").alias("load")).where(
        "series_id IS NOT NULL AND hr IS NOT NULL")
    # The filter keeps every row. It makes all uses of the hourly sums read the same columns whatever
    # the caller selects, so the raw rows are scanned and summed once.
    hours = raw.groupBy("series_id", "hr").agg(
        F.sum("load").alias("load"), F.count(F.lit(1)).alias("n_obs")).where(
        "n_obs > 0 OR load IS NOT NULL").withColumn("_block", F.floor(F.col("hr") / block_hours))
    ends = hours.groupBy("series_id", "_block").agg(F.min("hr").alias("_first"), F.max("hr").alias("_last"))
    whole = Window.partitionBy("series_id")  # a row per block
    blocks = ends.select(
        "series_id", "_block", F.lead("_first").over(whole.orderBy("_block")).alias("_after"),
        F.min("_first").over(whole).alias("_lo"), F.max("_last").over(whole).alias("_hi"))
    if span == "global":
        both = ends.agg(F.min("_first").alias("lo"), F.max("_last").alias("hi"))
        lo, hi = both.select("lo").scalar(), both.select("hi").scalar()
    elif span == "series":
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        raise ValueError("span must be 'global' or 'series'")
    inside = Window.partitionBy("series_id", "_block").orderBy("hr")
    # A row stands for up to a whole span of empty hours, so its bytes say little about the work behind it: a fixed
    # number of tasks, which adaptive execution does not merge.
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hours.join(blocks, ["series_id", "_block"]).repartition(tasks, "series_id", "_block").select(
        "series_id", "hr", "n_obs", F.coalesce("load", F.lit(0.0)).alias("load"), "_lo",
        F.coalesce(F.lead("hr").over(inside), "_after").alias("_next"), lo.alias("lo"), hi.alias("hi"))
    hr, none = F.col("hr"), F.lit(0).cast("bigint")

    def run(start: Column, length: Column, load: Column, n_obs: Column) -> Column:
        return F.struct((start - F.col("lo")).alias("start"), length.alias("length"), load.alias("load"),
                        n_obs.alias("n_obs"))

    zero = F.lit(0.0)
    runs = F.array(
        run(F.col("lo"), F.when(hr == F.col("_lo"), hr - F.col("lo")).otherwise(none), zero, none),
        run(hr, F.lit(1).cast("bigint"), F.col("load"), F.col("n_obs")),
        run(hr + 1, F.coalesce("_next", F.col("hi") + 1) - hr - 1, zero, none))
    cells = rows.select("series_id", "lo", (F.col("hi") - F.col("lo") + 1).alias("n"),
                        F.explode(F.filter(runs, lambda c: c["length"] > 0)).alias("_r"))
    return cells.select("series_id", "_r.start", "_r.length", "n", "lo", "_r.load", "_r.n_obs")


def dense(runs: DataFrame) -> DataFrame:
    """The rows of :func:`hourly_grid` from its runs, for operators that need every hour."""
    return runs.select(
        "series_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"),
        "n", "lo", "load", "n_obs").select(
        "series_id", hour_start(F.col("lo") + F.col("pos")).alias("ts"), "pos", "n", "load", "n_obs")
