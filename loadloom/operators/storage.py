"""Battery dispatch against a time-of-use tariff, and its economics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..config import (DAYS_PER_MONTH, DAYS_PER_YEAR, HOURS_PER_YEAR, STRATEGIES, Battery, Strategy,
                      Tariff)
from ..functions.timeparts import hour_index, hour_start, tariff_zone, zone_price
from .blocks import BLOCK_ROWS, running_sum
from .pieces import Pieces
from .scan import state_scan

PLAN = ("series_id", "strategy")
SLACK = 0.1  # kWh; closer to a limit than this the battery rests


FLOWS = ("soc_before", "soc", "charged", "discharged")


def _charge(soc, high: float, power: float):
    """What a battery takes in a night hour; of a number or of an array."""
    return np.where(soc < high - SLACK, np.minimum(power, high - soc), 0.0)


def _discharge(soc, low: float, most):
    """What it gives in a peak hour, at most ``most``."""
    return np.where(soc > low + SLACK, np.fmin(most, soc - low), 0.0)


def _limits(columns: dict[str, np.ndarray], battery: Battery, cap_to_demand: bool):
    """(night, peak, most to give) of the rows and the corridor of the plan. A missing load is no limit."""
    zone = columns["zone"]
    most = np.full(len(zone), battery.max_power)
    if cap_to_demand:
        most = np.fmin(most, columns["load"].astype(float) / np.sqrt(battery.efficiency))
    return zone == "night", zone == "peak", most, float(columns["soc_low"][0]), float(columns["soc_high"][0])


def _dispatch_step(battery: Battery, cap_to_demand: bool):
    """Fill one chunk from its entry state.

    The rows lie in lanes of equal length that run side by side. Each lane starts from the exit of the lane before,
    as far as that is known; lanes whose start was wrong run again. Every reached limit ends that, so two or
    three rounds are usual, and the result is that of a row after the other to the last bit.
    """
    power, capacity = battery.max_power, battery.capacity

    def step(columns: dict[str, np.ndarray], soc: float):
        night, peak, most, low, high = _limits(columns, battery, cap_to_demand)
        n = len(night)
        width = int(np.ceil(np.sqrt(n)))
        lanes = -(-n // width)

        def laned(x: np.ndarray) -> np.ndarray:  # (width, lanes); rows behind the end rest
            return np.pad(x, (0, width * lanes - n)).reshape(lanes, width).T.copy()

        night, peak, most = laned(night), laned(peak), laned(most)
        before, level, stored, drawn = np.zeros((4, width, lanes))
        entry = np.full(lanes, soc)
        todo = np.arange(lanes)
        while len(todo):
            s = entry[todo]
            for i in range(width):
                before[i, todo] = s
                taken = np.where(night[i, todo], _charge(s, high, power), 0.0)
                given = np.where(peak[i, todo], _discharge(s, low, most[i, todo]), 0.0)
                s = np.clip(s + taken - given, 0.0, capacity)
                level[i, todo], stored[i, todo], drawn[i, todo] = s, taken, given
            start = np.concatenate([[soc], level[-1, :-1]])
            todo = np.flatnonzero(start != entry)
            entry = start

        def rows(x: np.ndarray) -> np.ndarray:
            return x.T.ravel()[:n]

        return ({"soc_before": rows(before), "soc": rows(level), "charged": rows(stored), "discharged": rows(drawn)},
                float(level[(n - 1) % width, -1]))

    return step


def _row_map(battery: Battery, night: bool, peak: bool, most: float, low: float, high: float) -> Pieces:
    """What one hour does to any state of charge."""
    capacity = battery.capacity
    if night:
        rest, power = high - SLACK, battery.max_power
        full = min(high - power, rest)
        parts = [(0.0, False, power), (full, True, high), (rest, False, 0.0)]
    elif peak:
        work = float(np.nextafter(low + SLACK, np.inf))
        parts = [(0.0, False, 0.0), (work, True, low), (max(work, low + most), False, -most)]
        if most < 0:  # a negative demand is an inflow, which ends at the capacity
            parts.append((max(work, capacity + most), True, capacity))
    else:
        parts = [(0.0, False, 0.0)]
    # Pieces that lie below the lowest state, or that the next one covers, have no states.
    parts = [(max(start, 0.0), fixed, value) for start, fixed, value in parts]
    kept = [p for p, after in zip(parts, [*parts[1:], (np.inf,)]) if p[0] < after[0]]
    return Pieces(tuple(kept), capacity)


def _dispatch_map(battery: Battery, cap_to_demand: bool):
    """The map of a chunk: row by row up to the hour where all states meet, from there as one state."""
    step = _dispatch_step(battery, cap_to_demand)

    def summary(columns: dict[str, np.ndarray]) -> Pieces:
        night, peak, most, low, high = _limits(columns, battery, cap_to_demand)
        made = Pieces.identity(0.0, battery.capacity)
        for i in range(len(night)):
            if not (night[i] or peak[i]):
                continue
            row = _row_map(battery, night[i], peak[i], float(most[i]), low, high)

            def exact(soc: float) -> float:
                moved = soc + _charge(soc, high, battery.max_power) if night[i] else soc - _discharge(soc, low, most[i])
                return float(np.clip(moved, 0.0, battery.capacity))

            made = made.then(row, exact)
            if made.constant is not None and i + 1 < len(night):
                _, end = step({c: x[i + 1:] for c, x in columns.items()}, made.constant)
                return Pieces(((0.0, True, end),), battery.capacity)
        return made

    return summary


def dispatch(df: DataFrame, battery: Battery, strategies: Sequence[Strategy] = STRATEGIES,
             tariff: Tariff = Tariff(), value: str = "load", horizon: int | None = None,
             use_holidays: bool = False, cap_to_demand: bool = False,
             chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Hourly battery schedule of every series under every strategy.

    Night charges up to the corridor's top, peak discharges down to its bottom. The
    zones follow the rows' own timestamps; ``value`` may be an actual or a forecast.
    Delivered energy beyond the demand is lost unless ``cap_to_demand``. All hours take
    part; ``horizon`` keeps the first ones of a series only.

    The state of charge depends on the clock and the corridor, not on the load, so the
    recurrence runs once per distinct starting hour and its result is joined to the
    series. Only ``cap_to_demand`` ties it to the load and needs a scan per series.
    """
    battery.require_cost()
    corridors = F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(s.name).alias("strategy"),
                 F.lit(s.min_soc * battery.capacity).alias("soc_low"),
                 F.lit(s.max_soc * battery.capacity).alias("soc_high"))
        for i, s in enumerate(strategies)])
    rows = df.select("series_id", "ts", "pos", F.col(value).cast("double").alias("load"))
    if horizon is not None:
        rows = rows.where(F.col("pos") < horizon)
    step, summary = _dispatch_step(battery, cap_to_demand), _dispatch_map(battery, cap_to_demand)
    start_soc = battery.initial_soc * battery.capacity

    def zoned(table: DataFrame) -> DataFrame:
        return table.withColumn("zone", tariff_zone(F.col("ts"), use_holidays))

    if cap_to_demand:
        made = state_scan(zoned(rows).select("*", F.inline(corridors)), step, start_soc, FLOWS,
                          keys=PLAN, horizon=horizon, chunk_rows=chunk_rows, summary=summary)
    else:
        rows = rows.withColumn("start", hour_index(F.col("ts")) - F.col("pos"))
        clocks = rows.groupBy("start").agg(F.max("pos").alias("last")).select(
            "start", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("pos"))
        clocks = zoned(clocks.withColumn("ts", hour_start(F.col("start") + F.col("pos"))))
        plan = state_scan(clocks.drop("ts").select("*", F.inline(corridors)), step, start_soc,
                          FLOWS, keys=("start", "strategy"), horizon=horizon,
                          chunk_rows=chunk_rows, summary=summary)
        made = rows.join(plan, ["start", "pos"]).drop("start")
    load, efficiency = F.col("load"), float(np.sqrt(battery.efficiency))
    grid = F.when(F.col("discharged") > 0, F.greatest(
        F.lit(0.0), load - F.col("discharged") * efficiency)).otherwise(
        load + F.col("charged") / efficiency)
    action = (F.when(F.col("charged") > 0, "charge").when(F.col("discharged") > 0, "discharge")
              .otherwise("idle"))
    return made.withColumns({
        "price": zone_price(F.col("zone"), tariff), "grid_kwh": grid, "action": action,
    }).withColumn("cost", F.col("grid_kwh") * F.col("price"))


def cumulative_savings(schedule: DataFrame) -> DataFrame:
    """Running sum of the energy cost saved per series and strategy."""
    saved = schedule.withColumn("saved", (F.col("load") - F.col("grid_kwh")) * F.col("price"))
    return running_sum(saved, "saved", "cum_saved", keys=PLAN)


def storage_kpis(schedule: DataFrame, battery: Battery) -> DataFrame:
    """Costs, savings and payback per (series, strategy)."""
    cost = battery.require_cost()
    load, grid = F.col("load"), F.col("grid_kwh")
    peak = F.col("zone") == "peak"
    per = schedule.groupBy(*PLAN).agg(
        F.first("order").alias("order"), F.count(F.lit(1)).alias("hours"),
        F.sum(load * F.col("price")).alias("baseline_cost"),
        F.sum("cost").alias("optimized_cost"),
        # Without any peak hour in the horizon the demand charge looks at all hours.
        F.coalesce(F.max(F.when(peak, load)), F.max(load)).alias("baseline_peak"),
        F.coalesce(F.max(F.when(peak, grid)), F.max(grid)).alias("optimized_peak"),
        F.sum(F.col("charged") + F.col("discharged")).alias("cycled_kwh"),
        F.count_if(F.col("action") == "charge").alias("charge_hours"),
        F.count_if(F.col("action") == "discharge").alias("discharge_hours"))
    days = F.greatest(F.col("hours") / 24.0, F.lit(1e-9))
    per = per.withColumn("demand_savings", F.greatest(
        F.lit(0.0), (F.col("baseline_peak") - F.col("optimized_peak"))
        * battery.demand_charge * (days / DAYS_PER_MONTH)))
    per = per.withColumns({
        "gross_savings": F.col("baseline_cost") - F.col("optimized_cost")
        + F.col("demand_savings"),
        "degradation_cost": F.col("cycled_kwh") * battery.cycle_cost,
        "om_cost": F.lit(cost * battery.om_share) * (days / DAYS_PER_YEAR),
    })
    per = per.withColumn("net_savings", F.col("gross_savings") - F.col("degradation_cost")
                         - F.col("om_cost"))
    per = per.withColumns({
        "net_pct": F.when(F.col("baseline_cost") > 0, F.col("net_savings")
                          / F.col("baseline_cost") * 100.0).otherwise(0.0),
        "annual_savings": F.col("net_savings") * (HOURS_PER_YEAR / F.col("hours")),
    })
    return per.withColumn("payback_years", F.when(
        F.col("annual_savings") > 0, cost / F.col("annual_savings")).otherwise(float("inf")))


def compare_strategies(df: DataFrame, battery: Battery, **options) -> DataFrame:
    """KPIs of all strategies for every series."""
    return storage_kpis(dispatch(df, battery, **options), battery)


def best_strategy(kpis: DataFrame) -> DataFrame:
    """The strategy with the largest net percentage; the first listed one on a tie."""
    key = F.struct(F.col("net_pct"), -F.col("order"))
    return kpis.groupBy("series_id").agg(F.max_by("strategy", key).alias("best_strategy"),
                                         F.max("net_pct").alias("net_pct"))
