"""Forecast-error aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-8


def mae(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p))


def rmse(t: Column, p: Column) -> Column:
    return F.sqrt(F.avg((t - p) * (t - p)))


def mape(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p) / (F.abs(t) + TINY)) * 100.0


def r2(t: Column, p: Column) -> Column:
    ss_res = F.sum((t - p) * (t - p))
    ss_tot = F.var_pop(t) * F.count(t)
    return F.lit(1.0) - ss_res / (ss_tot + TINY)


def smape(t: Column, p: Column) -> Column:
    return F.avg(F.abs(t - p) / (F.abs(t) + F.abs(p) + TINY)) * 200.0


def wape(t: Column, p: Column) -> Column:
    return F.sum(F.abs(t - p)) / (F.sum(F.abs(t)) + TINY) * 100.0


def mbe(t: Column, p: Column) -> Column:
    return F.avg(p - t)


def huber(t: Column, p: Column, delta: float = 0.05) -> Column:
    r = F.abs(t - p)
    return F.avg(F.when(r <= delta, r * r / 2.0).otherwise(delta * (r - delta / 2.0)))


def all_scores(t: Column, p: Column) -> list[Column]:
    """The seven scores, aliased."""
    return [
        mae(t, p).alias("mae"), rmse(t, p).alias("rmse"), mape(t, p).alias("mape"),
        r2(t, p).alias("r2"), smape(t, p).alias("smape"), wape(t, p).alias("wape"),
        mbe(t, p).alias("mbe"),
    ]


def composite(mae_col: Column, rmse_col: Column, acf24: Column) -> Column:
    """Ranking score, lower is better."""
    return (0.5 * mae_col + 0.3 * rmse_col
            + 0.2 * F.abs(F.coalesce(acf24, F.lit(0.0))) * mae_col)
