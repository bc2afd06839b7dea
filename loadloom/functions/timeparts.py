"""Calendar, tariff and cyclic expressions.

All of them work on ``TIMESTAMP_NTZ``, so no result depends on the session zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..config import HOLIDAYS, ZONE_CODES, Tariff

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970-01-01."""
    naive = ts.cast("timestamp_ntz")
    return (F.unix_date(naive.cast("date")).cast("bigint") * 24 + F.hour(naive)).cast("bigint")


def hour_start(index: Column) -> Column:
    """Timestamp of an hour index."""
    return F.timestamp_add("HOUR", index, F.expr(EPOCH))


def weekday(ts: Column) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def day_of_year0(ts: Column) -> Column:
    """Zero-based day of the year."""
    return F.dayofyear(ts) - 1


def is_holiday(ts: Column) -> Column:
    codes = [month * 100 + day for month, day in HOLIDAYS]
    return (F.month(ts) * 100 + F.dayofmonth(ts)).isin(codes).cast("int")


def is_new_year(ts: Column) -> Column:
    """1–8 January."""
    return ((F.month(ts) == 1) & F.dayofmonth(ts).between(1, 8)).cast("int")


def tariff_zone(ts: Column, use_holidays: bool = True) -> Column:
    """night / day / peak; holidays count as day only with ``use_holidays``."""
    hour = F.hour(ts)
    free_day = F.weekday(ts) >= 5
    if use_holidays:
        free_day = free_day | (is_holiday(ts) == 1)
    return zone_from_hour(hour, free_day)


def zone_from_hour(hour: Column, free_day: Column) -> Column:
    """Zone of an hour of day; on free days there is no peak."""
    in_peak = ((hour >= 10) & (hour < 17)) | ((hour >= 21) & (hour < 23))
    return (
        F.when((hour < 7) | (hour >= 23), "night")
        .when(free_day, "day")
        .when(in_peak, "peak")
        .otherwise("day")
    )


def zone_code(zone: Column) -> Column:
    """Ordinal code of the zone; unknown zones count as day."""
    code = F.lit(None).cast("double")
    for name, value in ZONE_CODES.items():
        code = F.when(zone == name, F.lit(value)).otherwise(code)
    return F.coalesce(code, F.lit(ZONE_CODES["day"]))


def zone_price(zone: Column, tariff: Tariff = Tariff()) -> Column:
    return (
        F.when(zone == "night", F.lit(tariff.night))
        .when(zone == "peak", F.lit(tariff.peak))
        .when(zone == "day", F.lit(tariff.day))
    )


def is_peak_hour(zone: Column) -> Column:
    return (zone == "peak").cast("int")


def is_night_hour(zone: Column) -> Column:
    return (zone == "night").cast("int")


def season(ts: Column) -> Column:
    month = F.month(ts)
    return (
        F.when(month.between(3, 5), "spring")
        .when(month.between(6, 8), "summer")
        .when(month.between(9, 11), "autumn")
        .otherwise("winter")
    )


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """sin and cos of a periodic value."""
    angle = value * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
