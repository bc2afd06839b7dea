"""Fixed values and the parameter sets passed to operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results depend on them, so they are stated plainly ---------

# (month, day) of the public holidays.
HOLIDAYS = (
    (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8),
    (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4),
)

# Order of the feature vector.
CHANNELS = (
    "consumption", "hour_sin", "hour_cos", "is_peak", "is_night", "is_weekend",
    "is_holiday", "temperature", "temperature_sq", "tariff_enc", "doy_norm",
    "humidity", "wind_speed", "rolling_mean_24h", "rolling_std_24h",
    "lag_24h", "lag_48h", "lag_168h", "dow_sin", "dow_cos", "month_sin",
    "month_cos", "cloud_cover", "ev_load_norm", "solar_gen_norm", "dsr_active",
)

# Channels handed to the two-part (series + covariates) model input.
COVARIATES = (
    "hour_sin", "hour_cos", "is_peak", "is_weekend", "is_holiday", "temperature",
    "lag_24h", "lag_168h", "ev_load_norm", "dsr_active",
)

# (least history, patch length); the stride is half the length.
PATCH_LENGTHS = ((192, 24), (96, 12), (48, 8), (0, 6))

ZONE_CODES = {"night": 0.0, "day": 0.5, "peak": 1.0}
LAGS = (24, 48, 168)
NAIVE_WEIGHTS = (0.60, 0.40)  # 24 h, 168 h
DAYS_PER_MONTH = 30.4375
DAYS_PER_YEAR = 365.25
HOURS_PER_YEAR = 8760.0


@dataclass(frozen=True)
class ForecastConfig:
    """Window geometry and the chronological split, in percent."""

    history: int = 48
    horizon: int = 24
    train_pct: int = 70
    val_pct: int = 15
    seasonal_diff: bool = False
    huber_delta: float = 0.05
    backtest_windows: int = 8


FAST = ForecastConfig(history=48, horizon=24)
OPTIMAL = ForecastConfig(history=192, horizon=24)
FULL = ForecastConfig(history=192, horizon=24)


@dataclass(frozen=True)
class Tariff:
    """Price per kWh by zone."""

    night: float = 1.80
    day: float = 4.20
    peak: float = 6.50


@dataclass(frozen=True)
class Battery:
    """Battery and its economics. The purchase cost has no default on purpose."""

    cost: float | None = None
    capacity: float = 300.0
    max_power: float = 150.0
    efficiency: float = 0.95
    cycle_cost: float = 0.06
    initial_soc: float = 0.50
    demand_charge: float = 950.0
    om_share: float = 0.015

    def require_cost(self) -> float:
        """The purchase cost, or TypeError when it was not given."""
        if self.cost is None:
            raise TypeError("Battery.cost must be given: O&M and payback depend on it")
        return float(self.cost)


CITY_BATTERY = Battery(cost=45_000_000.0, capacity=4_500.0, max_power=2_250.0)


@dataclass(frozen=True)
class Strategy:
    """State-of-charge corridor, as shares of the capacity."""

    name: str
    min_soc: float
    max_soc: float


STRATEGIES = (
    Strategy("conservative", 0.40, 0.60),
    Strategy("moderate", 0.25, 0.75),
    Strategy("aggressive", 0.08, 0.92),
)


@dataclass(frozen=True)
class WeatherResponse:
    """Coefficients of the weather-response index."""

    setpoint: float = 18.0
    quadratic: float = 2.5e-4
    humidity_threshold: float = 60.0
    humidity: float = 0.30
    wind_below: float = 10.0
    wind: float = 0.15
    winter_boost: float = 0.15
    summer_dip: float = 0.10


@dataclass(frozen=True)
class TreeConfig:
    """Boosted-tree settings."""

    rounds: int = 500
    depth: int = 5
    rate: float = 0.05
    subsample: float = 0.80
    colsample: float = 0.40
    min_child: int = 10
    #: Rounds without a lower validation error after which boosting ends.
    patience: int = 50
