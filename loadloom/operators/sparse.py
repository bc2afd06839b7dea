"""Statistics of hourly series from their runs (``sources/runs.py``), without a row per empty hour.

Everything equals the operator of the same purpose on the dense grid. Empty hours enter by their number: as a value of
multiplicity ``length`` in tallies, as a second group in the moments, and by arithmetic on the clock in profiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import adjusted_kurtosis, adjusted_skew
from .blocks import BLOCK_ROWS, Blocks, exact_quantiles

WEEK = 168
#: Hour of the week, Monday 0:00 being 0, of the hour with index 0 (a Thursday).
EPOCH_HOUR = 72


def busy(runs: DataFrame) -> DataFrame:
    """The hours with events."""
    return runs.where(F.col("n_obs") > 0)


def central_sums(runs: DataFrame) -> DataFrame:
    """(series_id, n, mean, m2, m3, m4, min, max): count, mean and sums of central powers over all hours.

    The busy hours are aggregated about their own mean; the zeros are then merged in as a second group of mean 0, by
    the formulas for the moments of a union. One aggregation, and no large numbers cancel.
    """
    some = F.col("n_obs") > 0
    x = F.when(some, F.col("load"))
    per = runs.groupBy("series_id").agg(
        F.max("n").alias("n"), F.count(x).alias("_k"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"), F.min("load").alias("min"), F.max("load").alias("max"))
    k, n, m, v = F.col("_k").cast("double"), F.col("n").cast("double"), F.col("_m"), F.col("_v")
    z = n - k
    flat = v == 0
    a2 = k * v
    a3 = F.when(flat, 0.0).otherwise(F.col("_g1") * F.pow(v, 1.5) * k)
    a4 = F.when(flat, 0.0).otherwise((F.col("_g2") + 3.0) * v * v * k)
    return per.select(
        "series_id", "n", (m * k / n).alias("mean"),
        (a2 + m * m * k * z / n).alias("m2"),
        (a3 + m * m * m * k * z * (z - k) / (n * n) + 3.0 * m * z * a2 / n).alias("m3"),
        (a4 + F.pow(m, F.lit(4.0)) * k * z * (k * k - k * z + z * z) / (n * n * n)
         + 6.0 * m * m * z * z * a2 / (n * n) + 4.0 * m * z * a3 / n).alias("m4"), "min", "max")


def moments(runs: DataFrame) -> DataFrame:
    """As :func:`profile.moments`: coefficient of variation, adjusted skewness and excess kurtosis."""
    n, m2 = F.col("n").cast("double"), F.col("m2")
    varied = m2 > 0
    return central_sums(runs).select(
        "series_id", "n", (F.sqrt(m2 / F.when(n > 1, n - 1.0)) / F.nullif("mean", F.lit(0.0))).alias("cv"),
        adjusted_skew(F.when(varied, F.sqrt(n) * F.col("m3") / F.pow(m2, 1.5)), n).alias("skew"),
        adjusted_kurtosis(F.when(varied, n * F.col("m4") / (m2 * m2) - 3.0), n).alias("kurt"))


def describe(runs: DataFrame) -> DataFrame:
    """As :func:`profile.describe`: count, mean, std, min, quartiles, max. An empty run is one value with
    its length as count, so the quantiles order busy hours and one zero."""
    n = F.col("n").cast("double")
    basic = central_sums(runs).select(
        "series_id", F.col("n").alias("count"), "mean",
        F.sqrt(F.col("m2") / F.when(n > 1, n - 1.0)).alias("std"), "min", "max")
    quartiles = exact_quantiles(runs, "load", {"q25": 0.25, "q50": 0.50, "q75": 0.75}, weight="length")
    return basic.join(quartiles, "series_id", "left")


def week_table(runs: DataFrame) -> DataFrame:
    """(series_id, phase, hours, total): hours of the span and load in each hour of the week.

    ``phase`` is 24 x weekday + hour, Monday first. The hours come from the ends of the span alone, so a series
    sends at most 168 rows however long it is; phases outside a short span are left out.
    """
    at = F.pmod(F.col("lo") + F.col("start") + EPOCH_HOUR, F.lit(WEEK)).cast("int")
    totals = busy(runs).groupBy("series_id", at.alias("phase")).agg(F.sum("load").alias("total"))
    first = F.pmod(F.col("lo") + EPOCH_HOUR, F.lit(WEEK))
    spans = runs.groupBy("series_id").agg(F.max("lo").alias("lo"), F.max("n").alias("n")).select(
        "series_id", "n", first.alias("_first"), F.explode(F.sequence(F.lit(0), F.lit(WEEK - 1))).alias("phase"))
    ahead = F.pmod(F.col("phase") - F.col("_first"), F.lit(WEEK))
    hours = F.floor((F.col("n") - 1 - ahead) / WEEK) + 1
    counts = spans.select("series_id", "phase", hours.alias("hours"), F.lit(0.0).alias("total")).where("hours > 0")
    none = F.lit(0).cast("bigint")
    return (counts.unionByName(totals.withColumn("hours", none)).groupBy("series_id", "phase")
            .agg(F.sum("hours").alias("hours"), F.sum("total").alias("total")))


def _mean(where: Column | None = None) -> Column:
    total, hours = F.col("total"), F.col("hours")
    if where is not None:
        total, hours = F.when(where, total), F.when(where, hours)
    return F.sum(total) / F.sum(hours)


def hour_profile(week: DataFrame) -> DataFrame:
    """Mean load per hour of the day, from :func:`week_table`."""
    return week.groupBy("series_id", (F.col("phase") % 24).cast("int").alias("hour")).agg(_mean().alias("mean_load"))


def weekday_profile(week: DataFrame) -> DataFrame:
    """Mean load per weekday, Monday 0, from :func:`week_table`."""
    return week.groupBy("series_id", F.floor(F.col("phase") / 24).cast("int").alias("weekday")).agg(
        _mean().alias("mean_load"))


def hour_weekday_pivot(week: DataFrame) -> DataFrame:
    """Mean load by hour, one column per weekday (wd0 = Monday), from :func:`week_table`."""
    day = F.floor(F.col("phase") / 24)
    return week.groupBy("series_id", (F.col("phase") % 24).cast("int").alias("hour")).agg(
        *[_mean(day == d).alias(f"wd{d}") for d in range(7)])


def lag_values(runs: DataFrame, lags: Sequence[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Busy hours (series_id, pos, n, load) with ``lag_{k}``: the load k hours before, 0 where that hour
    was empty, NULL before the span. A frame over positions finds it, so gaps need no rows."""
    blocks = Blocks(before=max(lags), rows=block_rows)
    hours = busy(runs).select("series_id", F.col("start").alias("pos"), "n", "load")
    new = {f"lag_{k}": F.when(F.col("pos") >= k, F.coalesce(
        F.sum("load").over(blocks.window().rangeBetween(-k, -k)), F.lit(0.0))) for k in lags}
    return blocks.core(blocks.spread(hours).withColumns(new))


def autocorrelation(runs: DataFrame, lags: Sequence[int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As :func:`residuals.autocorrelation` on the load: (series_id, n, acf_k …), NULL where n ≤ k.

    Σ (x_t − m)(x_{t−k} − m) needs the products of busy pairs and the sums of the hours behind the first k and before
    the last k; pairs with an empty hour have product 0. Series that are busy nearly always and vary little
    around a large mean lose digits here; the dense operator serves them.
    """
    pos, n, x = F.col("pos"), F.col("n"), F.col("load")
    sums = []
    for k in lags:
        late, early = F.sum(F.when(pos >= k, x)), F.sum(F.when(pos < n - k, x))
        sums += [F.sum(x * F.col(f"lag_{k}")).alias(f"_p{k}"),
                 (F.coalesce(late, F.lit(0.0)) + F.coalesce(early, F.lit(0.0))).alias(f"_s{k}")]
    per = lag_values(runs, lags, block_rows).groupBy("series_id").agg(*sums)
    per = central_sums(runs).select("series_id", "n", "mean", "m2").join(per, "series_id")
    m, out = F.col("mean"), []
    for k in lags:
        c = F.coalesce(f"_p{k}", F.lit(0.0)) - m * F.col(f"_s{k}") + (n - k) * m * m
        out.append(F.when((n > k) & (F.col("m2") > 0), c / F.col("m2")).alias(f"acf_{k}"))
    return per.select("series_id", "n", *out)
