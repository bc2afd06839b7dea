import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import hourly_pandas, to_spark
from loadloom.config import CHANNELS, ForecastConfig
from loadloom.operators import features, quality, windows
from loadloom.sources.grid import with_split

CFG = ForecastConfig(history=48, horizon=24)


@pytest.mark.parametrize("block_rows", [None, 200])
def test_lags_and_rolling_match_pandas(grid, hourly, block_rows):
    got = features.add_lags_and_rolling(grid, block_rows=block_rows).toPandas()
    got = got.sort_values(["series_id", "pos"])
    for name, part in got.groupby("series_id"):
        load = part["load"].reset_index(drop=True)
        for k in (24, 48, 168):
            np.testing.assert_allclose(part[f"load_lag_{k}h"], load.shift(k).bfill())
        for _, rows in part.groupby("split"):
            roll = rows["load"].rolling(24, min_periods=1)
            np.testing.assert_allclose(rows["rolling_mean_24h"], roll.mean())
            np.testing.assert_allclose(rows["rolling_std_24h"], roll.std().fillna(0), atol=1e-9)


def test_short_series_take_the_median(spark):
    pdf = hourly_pandas(5, series=("s",))  # 120 rows, fewer than 168
    got = features.add_lags_and_rolling(with_split(to_spark(spark, pdf))).toPandas()
    assert np.allclose(got["load_lag_168h"], pdf["load"].median())
    want = pdf["load"].shift(48).bfill()
    np.testing.assert_allclose(got.sort_values("pos")["load_lag_48h"], want)


def test_feature_table_order_scaling_and_clips(grid, hourly):
    table = features.feature_table(grid)
    assert tuple(c for c in table.columns if c in CHANNELS) == CHANNELS and len(CHANNELS) == 26
    got = table.toPandas().sort_values(["series_id", "pos"])
    a = got[got["series_id"] == "a"]
    load = hourly[hourly["series_id"] == "a"]["load"].to_numpy()
    low, high = load[:504].min(), load[:504].max()
    np.testing.assert_allclose(a["consumption"], (load - low) / (high - low))
    for c in ("rolling_mean_24h", "rolling_std_24h", "cloud_cover"):
        assert got[c].between(0, 1).all()
    for c in ("lag_24h", "lag_48h", "lag_168h"):
        assert got[c].between(0, 1.5).all()
    assert (got["humidity"] == 0).all() and got["temperature"].std() > 0


def test_scale_of_a_constant_series_and_way_back(spark):
    df = spark.createDataFrame([(5.0, 5.0, 5.0), (3.0, 1.0, 9.0)], "x double, lo double, hi double")
    s = features.scale(F.col("x"), F.col("lo"), F.col("hi"))
    rows = df.select(s.alias("s"), features.unscale(s, F.col("lo"), F.col("hi")).alias("u")).collect()
    assert [r.s for r in rows] == [0.0, 0.25] and [r.u for r in rows] == [5.0, 3.0]


def test_forecast_frame_by_hand(grid, hourly):
    frame = windows.forecast_frame(grid, CFG).toPandas()
    load = {k: g["load"].to_numpy() for k, g in hourly.groupby("series_id")}
    start = {"train": 0, "val": 504, "test": 612}
    assert len(frame) == 2 * (433 + 37 + 37) * 24
    pick = frame.sample(400, random_state=1)
    for r in pick.itertuples():
        t = start[r.split] + r.origin_idx + 47 + r.h
        assert r.y == load[r.series_id][t]
        assert r.naive_24 == load[r.series_id][t - 24]
        if t >= 168:
            assert r.naive_168 == load[r.series_id][t - 168]
            assert r.naive_dual == pytest.approx(
                0.6 * load[r.series_id][t - 24] + 0.4 * load[r.series_id][t - 168])
        else:
            assert r.naive_dual == r.naive_24
    parity = windows.forecast_frame(grid, CFG, weekly_lag=CFG.history).toPandas().iloc[0]
    t = start[parity.split] + parity.origin_idx + 47 + parity.h
    assert parity.naive_168 == load[parity.series_id][t - 48]


def test_views(grid):
    frame = windows.forecast_frame(grid, CFG)
    single = windows.single_origin_view(frame.where("split = 'train'"), CFG).toPandas()
    # Consecutive horizons: no target hour appears twice.
    assert not single.duplicated(["series_id", "pos"]).any()
    parity = windows.single_origin_view(frame.where("split = 'test'"), CFG, parity_rows=3)
    assert parity.select("origin_idx").distinct().count() == 3
    assert windows.walk_forward_view(frame).select("h").distinct().count() == 1


def flat_features(x: np.ndarray) -> np.ndarray:
    """Window features of one (T, F) window, straight from their definition."""
    c = x[:, 0]
    out = list(c)
    out += [c[-w:].mean() for w in (3, 6, 12, 24)] + [c[-w:].std() for w in (6, 24)]
    day = c[-24:]
    out += [day.min(), day.max(), day.max() - day.min()]
    out += [c[-1] - c[-2], c[-1] - c[-4], c[-1] - c[-25], c[-1] / (c[-25] + 1e-8)]
    out += list(x[-1, 1:])
    for w in (6, 12, 24, 48):
        out += list(x[-w:].mean(axis=0))
    for w in (6, 24):
        out += list(x[-w:].std(axis=0))
    return np.array(out)


def test_lag_features_match_the_window_definition(grid):
    channels = ("consumption", "hour_sin", "temperature", "lag_24h")
    table = features.feature_table(grid).cache()
    names = windows.lag_feature_names(CFG, channels)
    got = windows.lag_features(table, CFG, channels).toPandas()
    raw = windows.sliding_windows(table, CFG, channels).toPandas()
    both = got.merge(raw, on=["series_id", "split", "origin_ts"], suffixes=("", "_w"))
    assert len(both) == len(got) == 2 * (433 + 37 + 37)
    for _, r in both.sample(60, random_state=2).iterrows():
        x = np.array([list(step) for step in r["x"]])
        assert x.shape == (48, 4)
        np.testing.assert_allclose(r[names].to_numpy(dtype=float), flat_features(x), atol=1e-9)
        np.testing.assert_allclose(list(r["y"]), list(r["y_w"]))
    table.unpersist()


def test_feature_count():
    assert len(windows.lag_feature_names(ForecastConfig(history=192), CHANNELS)) == 386


def test_patches_and_instance_norm(grid, hourly):
    hist = windows.load_history(grid, CFG)
    made = windows.patches(hist, 8, 4, 48).where("series_id = 'a' and split = 'train'")
    row = made.orderBy("origin_idx").first()
    load = hourly[hourly["series_id"] == "a"]["load"].to_numpy()
    assert len(row.patches) == (48 - 8) // 4 + 1
    np.testing.assert_allclose(row.patches[3], load[12:20])
    assert [windows.patch_geometry(n) for n in (192, 96, 48, 24)] == [(24, 12), (12, 6), (8, 4), (6, 3)]
    norm = windows.instance_norm(grid, CFG).where("series_id = 'a' and split = 'train'")
    first = norm.orderBy("pos").first()
    assert first.win_mean == pytest.approx(load[:48].mean())
    assert first.normed == pytest.approx((load[47] - load[:48].mean()) / (load[:48].std() + 1e-6))


def test_picked_channels(grid):
    made = windows.sliding_windows(grid, CFG, ("load", "temperature", "pos"), "load")
    row = windows.pick_channels(made, ("load", "temperature", "pos"), ("pos", "load")).first()
    assert len(row.covariates) == 48
    assert row.covariates[5] == [row.x[5][2], row.x[5][0]]


def test_latest_window_and_its_checks(grid, hourly):
    rows = windows.latest_window(grid, 48, ("load", "temperature")).toPandas()
    tail = hourly[hourly["series_id"] == "b"].tail(48)
    x = rows[rows["series_id"] == "b"]["x"].iloc[0]
    np.testing.assert_allclose([s[0] for s in x], tail["load"])
    windows.check_latest(grid, 48, ("load",))
    with pytest.raises(ValueError):
        windows.check_latest(grid, 721, ("load",))
    with pytest.raises(ValueError):
        windows.check_latest(grid, 48, ("load", "absent"))


def test_window_integrity(grid):
    table = features.feature_table(grid)
    good = quality.window_integrity(table, CFG, ("consumption", "temperature")).collect()
    assert {r.status for r in good} <= {"pass", "warn"} and len(good) == 6
    broken = table.withColumn("temperature", F.when(F.col("pos") == 3, F.lit(float("nan")))
                              .otherwise(F.col("temperature")))
    bad = quality.window_integrity(broken, CFG, ("consumption", "temperature")).collect()
    assert {r["split"] for r in bad if r.status == "fail"} == {"train"}
