import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import hourly_pandas, to_spark
from loadloom.config import ForecastConfig
from loadloom.operators import profile, residuals, sparse, window_store, windows
from loadloom.operators.blocks import exact_quantiles
from loadloom.session import scratch_path
from loadloom.sources.grid import hourly_grid, with_split
from loadloom.sources.runs import dense, hour_runs

SMALL = ForecastConfig(history=5, horizon=3)


def events_of(spark, rows):
    """(series, hour from 2024-01-03, value) to raw events."""
    df = spark.createDataFrame(rows, "s string, h int, value double")
    return df.select("s", F.timestamp_add("HOUR", F.col("h"), F.expr("timestamp_ntz'2024-01-03 00:30:00'")).alias("ts"),
                     "value")


EVENTS = ([("a", 3 * i % 700, float(i % 7) + 0.25) for i in range(400)]  # repeats some hours
          + [("b", 5, 2.0), ("b", 6, 2.0), ("b", 400, 9.0), ("b", 401, None)]
          + [("one", 77, 4.5), ("null", 10, None), (None, 1, 1.0), ("b", None, 1.0)])


@pytest.fixture(scope="module")
def events(spark):
    return events_of(spark, EVENTS).cache()


def by_series(df, *order):
    return df.toPandas().sort_values(["series_id", *order]).reset_index(drop=True)


@pytest.mark.parametrize("span", ["global", "series"])
@pytest.mark.parametrize("block", [24, 8192])
def test_runs_cover_the_grid_once(events, span, block):
    runs = hour_runs(events, "s", span=span, block_hours=block)
    want = by_series(hourly_grid(events, "s", span=span), "pos")
    pd.testing.assert_frame_equal(by_series(dense(runs), "pos"), want[["series_id", "ts", "pos", "n", "load", "n_obs"]])
    rows = by_series(runs, "start")
    for _, part in rows.groupby("series_id"):
        assert part["start"].iloc[0] == 0
        assert (part["start"] + part["length"]).tolist()[:-1] == part["start"].tolist()[1:]
        assert part["length"].sum() == part["n"].iloc[0]
        empty = (part["n_obs"] == 0).to_numpy()
        assert not (empty[1:] & empty[:-1]).any()  # neighbouring empty hours are one run
        assert len(part) <= 2 * (~empty).sum() + 1


def test_rows_grow_with_events_not_with_hours(spark):
    far = events_of(spark, [("a", 0, 1.0), ("a", 200_000, 2.0)])
    assert hour_runs(far, "s").count() == 3
    got = sparse.describe(hour_runs(far, "s")).first()
    assert (got["count"], got["q50"], got["max"]) == (200_001, 0.0, 2.0)
    assert got["mean"] == pytest.approx(3 / 200_001)


def test_span_must_be_known(events):
    with pytest.raises(ValueError):
        hour_runs(events, "s", span="week")


def test_no_events(spark):
    runs = hour_runs(events_of(spark, []), "s")
    assert runs.count() == 0 and dense(runs).count() == 0
    for made in (sparse.describe(runs), sparse.moments(runs), sparse.week_table(runs),
                 sparse.autocorrelation(runs, (1, 2))):
        assert made.count() == 0


@pytest.mark.parametrize("span", ["global", "series"])
def test_statistics_equal_those_of_the_grid(events, span):
    runs, grid = hour_runs(events, "s", span=span), hourly_grid(events, "s", span=span)
    pairs = [
        (sparse.describe(runs), profile.describe(grid), ()),
        (sparse.hour_profile(sparse.week_table(runs)), profile.hour_profile(grid), ("hour",)),
        (sparse.weekday_profile(sparse.week_table(runs)), profile.weekday_profile(grid), ("weekday",)),
        (sparse.hour_weekday_pivot(sparse.week_table(runs)), profile.hour_weekday_pivot(grid), ("hour",)),
    ]
    varied = "series_id in ('a', 'b')"
    pairs += [
        (sparse.moments(runs.where(varied)), profile.moments(grid.where(varied)), ()),
        (sparse.autocorrelation(runs.where(varied), (1, 3, 24, 168), block_rows=200),
         residuals.autocorrelation(grid.where(varied), "load", (1, 3, 24, 168), eps=0.0), ()),
    ]
    for got, want, order in pairs:
        a, b = by_series(got, *order), by_series(want, *order)
        assert list(a) == list(b)
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_lag_values_over_gaps_and_blocks(events):
    got = by_series(sparse.lag_values(hour_runs(events, "s"), (1, 24, 168), block_rows=170), "pos")
    grid = by_series(hourly_grid(events, "s"), "pos")
    grid = pd.concat([g.assign(**{f"lag_{k}": g["load"].shift(k) for k in (1, 24, 168)})
                      for _, g in grid.groupby("series_id")])
    want = grid[grid["n_obs"] > 0].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[list(got)], check_dtype=False)


def test_series_without_spread(spark):
    """A series of zeros only, and one of a single hour: no division by zero."""
    runs = hour_runs(events_of(spark, [("z", 0, 0.0), ("z", 9, 0.0), ("u", 4, 3.0)]), "s", span="series")
    got = {r.series_id: r for r in sparse.moments(runs).collect()}
    assert (got["z"].cv, got["z"].skew, got["z"].kurt) == (None, None, None)
    assert got["u"].n == 1 and got["u"].cv is None
    acf = {r.series_id: r for r in sparse.autocorrelation(runs, (1,)).collect()}
    assert acf["z"].acf_1 is None and acf["u"].acf_1 is None


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-4, 4)), min_size=2, max_size=30))
@settings(max_examples=8, deadline=None)
def test_merged_moments_against_numpy(spark, cells):
    runs = hour_runs(events_of(spark, [("x", h, float(v)) for h, v in cells]), "s", span="series")
    r = sparse.central_sums(runs).first()
    hours = [h for h, _ in cells]
    x = np.zeros(max(hours) - min(hours) + 1)
    for h, v in cells:
        x[h - min(hours)] += v
    d = x - x.mean()
    assert r.n == len(x)
    np.testing.assert_allclose([r["mean"], r.m2, r.m3, r.m4],
                               [x.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum()], atol=1e-8)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("k", 0.0, 97), ("k", 5.0, 2), ("k", 7.0, 1)], "series_id string, v double, w bigint")
    got = exact_quantiles(df, "v", {"a": 0.5, "b": 0.975, "c": 1.0}, weight="w").first()
    want = np.quantile([0.0] * 97 + [5.0] * 2 + [7.0], [0.5, 0.975, 1.0])
    assert [got.a, got.b, got.c] == pytest.approx(list(want))


@pytest.fixture(scope="module")
def rows(spark):
    pdf = hourly_pandas(9)
    pdf["extra"] = np.arange(len(pdf)) * 0.5
    return with_split(to_spark(spark, pdf))


@pytest.mark.parametrize("block", [10, 100, 8192])
def test_windows_of_a_store_equal_copied_windows(spark, rows, block):
    path = scratch_path(spark, "store")
    window_store.write_blocks(rows, SMALL, ("load", "extra"), path, target="load", rows=block)
    got = by_series(window_store.read_windows(spark.read.parquet(path), SMALL, ("load", "extra"), block), "origin_ts")
    want = by_series(windows.sliding_windows(rows, SMALL, ("load", "extra"), "load"), "origin_ts")
    assert got[["series_id", "split", "origin_ts", "origin_idx"]].equals(
        want[["series_id", "split", "origin_ts", "origin_idx"]])
    np.testing.assert_array_equal(np.stack(got["x"]), np.stack([np.concatenate(x) for x in want["x"]]))
    np.testing.assert_array_equal(np.stack(got["y"]), np.stack(want["y"]))


def test_a_store_holds_every_hour_about_once(spark, rows):
    stored = window_store.block_rows(rows, SMALL, ("load",), "load", 50)
    held = stored.agg(F.sum(F.size("y"))).first()[0]
    blocks = stored.count()
    assert held <= rows.count() + blocks * (SMALL.history - 1 + SMALL.horizon)


def test_small_batches_and_missing_values(spark, rows, monkeypatch):
    holes = rows.withColumn("load", F.when(F.col("pos") % 11 != 3, F.col("load")))
    path = scratch_path(spark, "store")
    window_store.write_blocks(holes, SMALL, ("load",), path, target="load")
    monkeypatch.setattr(window_store, "BATCH_NUMBERS", 20)
    store = spark.read.parquet(path)
    got = by_series(window_store.read_windows(store, SMALL, ("load",)), "origin_ts")
    load = {k: g["load"].where(g["pos"] % 11 != 3).to_numpy() for k, g in rows.toPandas().sort_values("pos").groupby("series_id")}
    start = {r.split: r.a for r in rows.groupBy("split").agg(F.min("pos").alias("a")).collect()}
    for r in got.itertuples():
        t = start[r.split] + r.origin_idx + SMALL.history - 1
        np.testing.assert_array_equal(np.array(r.x, float), load[r.series_id][t - 4:t + 1])
        np.testing.assert_array_equal(np.array(r.y, float), load[r.series_id][t + 1:t + 4])
    means = by_series(window_store.map_windows(
        store, SMALL, ("load",), lambda x, y: {"m": x.mean(axis=(1, 2)), "k": y[:, 0]}, ("m", "k")), "origin_ts")
    np.testing.assert_allclose(means["m"].astype(float), [np.mean(np.array(x, float)) for x in got["x"]])


def test_gaps_repeats_and_short_series(spark, rows):
    path = scratch_path(spark, "store")
    for broken in (rows.where("pos <> 20"), rows.unionByName(rows.where("pos = 20"))):
        with pytest.raises(Exception, match="hours missing or repeated"):
            window_store.block_rows(broken, SMALL, ("load",), "load").collect()
    short = with_split(to_spark(spark, hourly_pandas(1).query("pos < 6").assign(n=6)))
    window_store.write_blocks(short, SMALL, ("load",), path, target="load")
    assert window_store.read_windows(spark.read.parquet(path), SMALL, ("load",)).count() == 0
    none = scratch_path(spark, "store")
    window_store.write_blocks(rows.where("false"), SMALL, ("load",), none, target="load")
    assert window_store.read_windows(spark.read.parquet(none), SMALL, ("load",)).count() == 0
