"""Weather and deterministic trend expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..config import DAYS_PER_YEAR, WeatherResponse


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    """Logistic function with the argument limited to ±20."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -20.0, 20.0)))


def bump(x: Column, centre: float, width: float) -> Column:
    """Gaussian bump of height 1."""
    return F.exp(-((x - centre) * (x - centre)) / (2.0 * width * width))


def heating_degree(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(18.0) - t)


def cooling_degree(t: Column) -> Column:
    return F.greatest(F.lit(0.0), t - F.lit(24.0))


def weather_response(t: Column, humidity: Column, wind: Column,
                     k: WeatherResponse = WeatherResponse()) -> Column:
    """Load multiplier: quadratic in temperature, plus humid-heat and cold-wind terms."""
    humid = sigmoid((humidity - k.humidity_threshold) / 10.0)
    breeze = F.log1p(wind)
    gap = t - k.setpoint
    return (
        F.lit(1.0) + F.lit(k.quadratic) * gap * gap
        + F.when(t > 22.0, F.lit(k.humidity) * humid).otherwise(0.0)
        + F.when(t < k.wind_below, F.lit(k.wind) * breeze).otherwise(0.0)
        + F.when((t > 28.0) & (humidity > 68.0) & (wind > 6.0), 0.07 * humid * breeze / 4.0)
        .otherwise(0.0)
    )


def trend_index(pos: Column) -> Column:
    """5 % growth per year, by hour position."""
    return F.lit(1.0) + F.lit(0.05) * (pos / F.lit(24.0 * DAYS_PER_YEAR))


def seasonal_drift(doy0: Column, k: WeatherResponse = WeatherResponse()) -> Column:
    """Yearly cosine between the winter boost and the summer dip."""
    middle = (k.winter_boost - k.summer_dip) / 2.0
    swing = (k.winter_boost + k.summer_dip) / 2.0
    return F.lit(1.0 + middle) + F.lit(swing) * F.cos(doy0 * F.lit(2.0 * math.pi) / F.lit(365.0))
