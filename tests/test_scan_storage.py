import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import hourly_pandas, to_spark
from loadloom.config import CITY_BATTERY, STRATEGIES, Battery
from loadloom.operators import scan, storage

BATTERY = Battery(cost=3_000_000.0)


def cascade_by_hand(load, rise=0.055):
    state, out = 0.0, []
    for x in load:
        state = min(state + rise, 0.25) if x > 1.35 * load.mean() else max(state - 0.04, 0.0)
        out.append(1 + state)
    return out


def test_cascade_in_chunks_is_bit_equal_to_one_pass(spark):
    rng = np.random.default_rng(2)
    pdf = pd.concat([pd.DataFrame({"series_id": k, "pos": np.arange(n), "n": n,
                                   "load": rng.exponential(50, n)})
                     for k, n in (("long", 1000), ("short", 30))])
    df = spark.createDataFrame(pdf)
    whole = scan.cascade(df).toPandas().sort_values(["series_id", "pos"])
    parts = scan.cascade(df, chunk_rows=64).toPandas().sort_values(["series_id", "pos"])
    assert list(whole["cascade"]) == list(parts["cascade"])
    load = pdf[pdf["series_id"] == "long"]["load"].to_numpy()
    assert list(whole[whole["series_id"] == "long"]["cascade"]) == cascade_by_hand(load)


def test_scan_that_never_forgets_its_start_is_still_exact(spark):
    # A plain sum carries the entry state through every chunk: the slowest case.
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": np.arange(40),
                                             "v": np.arange(40) + 0.25}))

    def step(columns, state):
        out = state + np.cumsum(columns["v"])
        return {"total": out}, float(out[-1])

    got = scan.state_scan(df, step, 1.0, ["total"], chunk_rows=8).toPandas().sort_values("pos")
    np.testing.assert_array_equal(got["total"], 1.0 + np.cumsum(np.arange(40) + 0.25))


def test_stress(spark, grid):
    rows = grid.withColumn("trigger", scan.stress_trigger(
        F.col("temperature"), F.hour("ts"), F.lit(0.3), F.lit(0.5)))
    got = scan.stress(rows, chunk_rows=100).where("series_id = 'a'").toPandas().sort_values("pos")
    state = 0.0
    for push, s, m in zip(got["trigger"], got["stress_state"], got["stress"]):
        state = min(max(0.9 * state + 0.1 * push, 0), 1.4)
        assert s == state
        assert m == pytest.approx(1 + 0.18 / (1 + np.exp(-6 * (s - 0.55))) + 0.06 * s * s)


def test_rebound(spark):
    flag = np.zeros(40, int)
    flag[[5, 6, 8, 30]] = 1
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": np.arange(40), "f": flag}))
    got = scan.rebound(df, "f").toPandas().sort_values("pos")["rebound"].to_numpy()
    want = np.zeros(40)
    for edge in (7, 9, 31):
        for k in range(4):
            want[edge + k] += 0.12 * np.exp(-0.65 * k)
    np.testing.assert_allclose(got, want)
    none = scan.rebound(df.withColumn("f", F.lit(0)), "f")
    assert none.agg(F.max("rebound")).first()[0] == 0.0


def simulate(load, ts, battery, low, high, cap=False):
    """The dispatch rule, hour by hour."""
    soc, eff = battery.initial_soc * battery.capacity, np.sqrt(battery.efficiency)
    low, high = low * battery.capacity, high * battery.capacity
    level, grid, cycled, zones = [], [], 0.0, []
    for x, t in zip(load, ts):
        night = t.hour < 7 or t.hour >= 23
        peak = (not night and t.dayofweek < 5
                and (10 <= t.hour < 17 or 21 <= t.hour < 23))
        zones.append("night" if night else "peak" if peak else "day")
        out = x
        if night and soc < high - 0.1:
            c = min(battery.max_power, high - soc)
            soc, out, cycled = soc + c, x + c / eff, cycled + c
        elif peak and soc > low + 0.1:
            d = min(battery.max_power, soc - low)
            if cap:
                d = min(d, x / eff)
            soc, out, cycled = soc - d, max(0.0, x - d * eff), cycled + d
        soc = min(max(soc, 0), battery.capacity)
        level.append(soc)
        grid.append(out)
    return np.array(level), np.array(grid), cycled, np.array(zones)


@pytest.mark.parametrize("cap,chunk", [(False, 8192), (False, 50), (True, 8192), (True, 100)])
def test_dispatch_matches_the_rule(spark, hourly, cap, chunk):
    df = to_spark(spark, hourly)
    got = storage.dispatch(df, BATTERY, cap_to_demand=cap, chunk_rows=chunk).toPandas()
    assert len(got) == 2 * 3 * 720
    for (series, strategy), part in got.groupby(["series_id", "strategy"]):
        part = part.sort_values("pos")
        own = hourly[hourly["series_id"] == series]
        s = next(x for x in STRATEGIES if x.name == strategy)
        level, grid, _, zones = simulate(own["load"], own["ts"], BATTERY, s.min_soc, s.max_soc, cap)
        np.testing.assert_allclose(part["soc"], level)
        np.testing.assert_allclose(part["grid_kwh"], grid)
        assert list(part["zone"]) == list(zones)
        assert part["soc"].between(0, BATTERY.capacity).all()
        assert part["soc_before"].iloc[0] == 150.0
        np.testing.assert_array_equal(part["soc_before"].iloc[1:], part["soc"].iloc[:-1])


def test_series_with_different_starts_have_their_own_clock(spark):
    early = hourly_pandas(5, ("x",))
    late = hourly_pandas(5, ("y",), start="2024-01-05 13:00")
    df = to_spark(spark, pd.concat([early, late]))
    got = storage.dispatch(df, BATTERY).where("strategy = 'moderate'").toPandas()
    for series, own in (("x", early), ("y", late)):
        part = got[got["series_id"] == series].sort_values("pos")
        level, *_ = simulate(own["load"], own["ts"], BATTERY, 0.25, 0.75)
        np.testing.assert_allclose(part["soc"], level)


def test_kpis(spark, hourly):
    kpis = storage.compare_strategies(to_spark(spark, hourly), BATTERY)
    r = kpis.where("series_id = 'a' and strategy = 'aggressive'").first()
    own = hourly[hourly["series_id"] == "a"]
    _, grid, cycled, zones = simulate(own["load"], own["ts"], BATTERY, 0.08, 0.92)
    price = np.array([{"night": 1.8, "day": 4.2, "peak": 6.5}[z] for z in zones])
    load = own["load"].to_numpy()
    base, opt = load @ price, grid @ price
    demand = max(0, (load[zones == "peak"].max() - grid[zones == "peak"].max()) * 950 * 30 / 30.4375)
    om = 3e6 * 0.015 * 30 / 365.25
    net = base - opt + demand - cycled * 0.06 - om
    assert r.baseline_cost == pytest.approx(base) and r.optimized_cost == pytest.approx(opt)
    assert r.demand_savings == pytest.approx(demand) and r.om_cost == pytest.approx(om)
    assert r.net_savings == pytest.approx(net) and r.net_pct == pytest.approx(net / base * 100)
    assert r.annual_savings == pytest.approx(net * 8760 / 720)
    if net > 0:
        assert r.payback_years == pytest.approx(3e6 / r.annual_savings)
    else:
        assert r.payback_years == float("inf")
    best = {x.series_id: x.net_pct for x in storage.best_strategy(kpis).collect()}
    assert best["a"] == pytest.approx(
        max(x.net_pct for x in kpis.where("series_id = 'a'").collect()))


def test_om_cost_of_the_city_battery(spark, hourly):
    r = storage.compare_strategies(to_spark(spark, hourly), CITY_BATTERY).first()
    assert r.om_cost == pytest.approx(55_441, abs=1)


def test_battery_cost_has_no_default(spark, grid):
    with pytest.raises(TypeError):
        storage.dispatch(grid, Battery())
    with pytest.raises(TypeError):
        storage.compare_strategies(grid, Battery())


def test_weekend_horizon_falls_back_to_all_hours(spark):
    pdf = hourly_pandas(2, ("w",), start="2024-01-06")  # Saturday and Sunday: no peak zone
    r = storage.compare_strategies(to_spark(spark, pdf), BATTERY).first()
    assert r.baseline_peak == pytest.approx(pdf["load"].max())


def test_cumulative_savings(spark, hourly):
    schedule = storage.dispatch(to_spark(spark, hourly), BATTERY)
    got = storage.cumulative_savings(schedule).toPandas().sort_values("pos")
    part = got[(got["series_id"] == "b") & (got["strategy"] == "moderate")]
    want = ((part["load"] - part["grid_kwh"]) * part["price"]).cumsum()
    np.testing.assert_allclose(part["cum_saved"], want)
