import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import hourly_pandas, to_spark
from loadloom.config import HOLIDAYS, ForecastConfig
from loadloom.functions import timeparts, weather
from loadloom.operators import calendar, quality, windows
from loadloom.sources.grid import hourly_grid, with_positions, with_split


@pytest.fixture(scope="module")
def events(spark):
    pdf = pd.DataFrame({
        "who": ["x", "x", "x", "y"],
        "ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 03:00",
                              "2024-01-01 01:59"]),
        "value": [1.0, 2.0, 5.0, 7.0]})
    return to_spark(spark, pdf)


def test_grid_fills_gaps_over_the_common_span(events):
    got = hourly_grid(events, "who").orderBy("series_id", "pos").collect()
    assert [(r.series_id, r.pos, r.n, r.load, r.n_obs) for r in got] == [
        ("x", 0, 4, 3.0, 2), ("x", 1, 4, 0.0, 0), ("x", 2, 4, 0.0, 0), ("x", 3, 4, 5.0, 1),
        ("y", 0, 4, 0.0, 0), ("y", 1, 4, 7.0, 1), ("y", 2, 4, 0.0, 0), ("y", 3, 4, 0.0, 0)]
    assert got[3].ts == dt.datetime(2024, 1, 1, 3)


def test_grid_with_own_span(events):
    got = {r.series_id: r for r in hourly_grid(events, "who", span="series")
           .groupBy("series_id").agg(F.count("*").alias("c"), F.max("n").alias("n"),
                                     F.min("pos").alias("p")).collect()}
    assert (got["x"].c, got["x"].n, got["x"].p) == (4, 4, 0)
    assert (got["y"].c, got["y"].n, got["y"].p) == (1, 1, 0)


def test_grid_does_not_depend_on_the_session_zone(spark, events):
    old = spark.conf.get("spark.sql.session.timeZone")
    first = sorted(map(str, hourly_grid(events, "who").collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(map(str, hourly_grid(events, "who").collect())) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_positions_of_a_complete_table(spark):
    pdf = hourly_pandas(2).drop(columns=["pos", "n"])
    got = with_positions(to_spark(spark, pdf)).toPandas()
    assert got.groupby("series_id")["pos"].apply(lambda s: sorted(s) == list(range(48))).all()
    assert set(got["n"]) == {48}


@pytest.mark.parametrize("n,history,sizes,counts", [
    (17520, 192, (12264, 2628, 2628), (12049, 2413, 2413)),
    (720, 48, (504, 108, 108), (433, 37, 37)),
    (100, 48, (70, 15, 15), (0, 0, 0)),
])
def test_split_and_window_counts(spark, n, history, sizes, counts):
    rows = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"),
                                 F.lit(n).cast("bigint").alias("n"))
    cfg = ForecastConfig(history=history, horizon=24)
    got = {r["split"]: r for r in windows.window_counts(with_split(rows), cfg).collect()}
    assert tuple(got[s].n_rows for s in ("train", "val", "test")) == sizes
    assert tuple(got[s].n_windows for s in ("train", "val", "test")) == counts


def zone_by_hand(hour, free):
    if hour < 7 or hour >= 23:
        return "night"
    if free:
        return "day"
    return "peak" if 10 <= hour < 17 or 21 <= hour < 23 else "day"


def test_calendar_and_zones_over_a_leap_year(spark):
    ts = pd.date_range("2024-01-01", "2025-01-10", freq="h")
    df = to_spark(spark, pd.DataFrame({"series_id": "s", "ts": ts}))
    rows = calendar.add_tariff(calendar.add_calendar(df)).withColumn(
        "plain", timeparts.tariff_zone(F.col("ts"), use_holidays=False))
    for r in rows.collect():
        t = r.ts
        holiday = (t.month, t.day) in HOLIDAYS
        assert r.weekday == t.weekday() and r.hour == t.hour and r.month == t.month
        assert r.day_of_year == t.timetuple().tm_yday - 1
        assert r.is_holiday == holiday and r.is_weekend == (t.weekday() >= 5)
        assert r.is_new_year == (t.month == 1 and t.day <= 8)
        assert r.tariff_zone == zone_by_hand(t.hour, holiday or t.weekday() >= 5)
        assert r.plain == zone_by_hand(t.hour, t.weekday() >= 5)
        assert r.season == ["winter", "spring", "summer", "autumn"][t.month % 12 // 3]
        assert r.price == {"night": 1.8, "day": 4.2, "peak": 6.5}[r.tariff_zone]


def test_zone_code_of_unknown_zone(spark):
    df = spark.createDataFrame([("night",), ("day",), ("peak",), ("other",), (None,)],
                               "tariff_zone string")
    assert [r.tariff_enc for r in calendar.encode_tariff(df).collect()] == [0, 0.5, 1, 0.5, 0.5]


def test_weather_expressions(spark):
    t = np.array([-30.0, 5, 18, 23, 29, 40])
    h = np.array([50.0, 90, 60, 70, 80, 95])
    w = np.array([0.0, 9, 3, 2, 7, 12])
    df = spark.createDataFrame(pd.DataFrame({"t": t, "h": h, "w": w}))
    got = df.select(weather.weather_response(F.col("t"), F.col("h"), F.col("w")).alias("r"),
                    weather.heating_degree(F.col("t")).alias("hd"),
                    weather.cooling_degree(F.col("t")).alias("cd")).toPandas()
    sg = 1 / (1 + np.exp(-(h - 60) / 10))
    want = (1 + 2.5e-4 * (t - 18) ** 2 + np.where(t > 22, 0.3 * sg, 0)
            + np.where(t < 10, 0.15 * np.log1p(w), 0)
            + np.where((t > 28) & (h > 68) & (w > 6), 0.07 * sg * np.log1p(w) / 4, 0))
    np.testing.assert_allclose(got["r"], want)
    np.testing.assert_allclose(got["hd"], np.maximum(0, 18 - t))
    np.testing.assert_allclose(got["cd"], np.maximum(0, t - 24))


def test_missing_columns_become_zeros(spark):
    df = calendar.ensure_columns(spark.range(2), ("id", "wind_speed"))
    assert df.columns == ["id", "wind_speed"] and df.first().wind_speed == 0.0


def test_quality_report_flags_bad_rows(spark, hourly):
    bad = hourly.copy()
    bad.loc[3, "load"] = -1.0
    bad.loc[bad.index[bad["series_id"] == "b"][5], "load"] = float("inf")
    clean = {(r.series_id, r.check): r for r in
             quality.quality_report(to_spark(spark, hourly)).collect()}
    dirty = {(r.series_id, r.check): r for r in
             quality.quality_report(to_spark(spark, bad)).collect()}
    assert clean["a", "negative"].status == "pass" and dirty["a", "negative"].status == "fail"
    assert dirty["b", "nan_inf"].value == 1 and dirty["b", "nan_inf"].status == "fail"
    a = hourly[hourly["series_id"] == "a"]
    x = (a["load"] - a["load"].mean()).to_numpy()
    want = np.mean(x[:-24] * x[24:]) / (x.var() + 1e-10)
    assert clean["a", "acf_24"].value == pytest.approx(want)
    assert clean["a", "acf_24"].status == "pass"
    assert clean["a", "cv"].value == pytest.approx(a["load"].std() / a["load"].mean())
    profile = a.groupby(a["ts"].dt.hour)["load"].mean()
    assert clean["a", "morning_peak"].value == profile.loc[6:11].idxmax()
    assert clean["a", "temp_min"].value == pytest.approx(a["temperature"].min())


def test_row_contract_and_drift(spark, grid):
    got = quality.row_contract(grid, days=30).collect()
    assert all(r.complete for r in got)
    assert not any(r.complete for r in quality.row_contract(grid, days=31).collect())
    raised = grid.withColumn("load", F.when(F.col("split") == "test", F.col("load") * 2)
                             .otherwise(F.col("load")))
    assert all(r.drift for r in quality.drift_check(raised).collect())
    assert not any(r.drift for r in quality.drift_check(grid).collect())


def test_hour_contract_finds_gaps_and_dropped_rows(spark):
    rows = [("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("a", "2024-01-01 01:00:00"),
            ("b", "2024-01-01 00:00:00"), ("b", "2024-01-01 02:00:00"), ("c", "2024-01-01 00:00:00"),
            ("c", None), ("d", None), (None, "2024-01-01 00:00:00")]
    raw = spark.createDataFrame(rows, "series_id string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.series_id: r[1:] for r in quality.hour_contract(raw).collect()}
    assert got == {"a": (2, 2, 3, 0, True), "b": (2, 3, 2, 0, False), "c": (1, 1, 1, 1, False),
                   "d": (0, None, 0, 1, False), None: (1, 1, 1, 0, False)}
