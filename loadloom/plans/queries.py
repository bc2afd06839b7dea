"""The registered queries: every operator over the driver's tables.

``events`` is the load table. A series is an event type or a user, the load is the sum
of ``value`` per hour, and the event count serves as the second channel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import CHANNELS, STRATEGIES, Battery, ForecastConfig, TreeConfig
from ..functions import scores, weather
from ..functions.stats import tidy, tidy_small
from ..operators import (calendar, decompose, ensemble, evaluate, features, models, profile,
                         quality, residuals, scan, sparse, stages, storage, sweep, window_store, windows)
from ..session import cut_lineage, scratch_path
from ..sources import cache, tables
from ..sources.bundle import export_bundle, load_bundle
from ..sources.grid import head, hourly_grid, with_positions, with_split
from ..sources.runs import dense, hour_runs

CFG = ForecastConfig(history=48, horizon=24)
BATTERY = Battery(cost=3_000_000.0)
FITTED_HORIZONS = (1, 12, 24)
SMALL_TREES = TreeConfig(rounds=4, depth=3)
MEMBERS = ("naive_24", "naive_168", "naive_dual")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    """Register under the function's name."""
    QUERIES[make.__name__] = make
    return make


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly grid, one series per event type."""
    return hourly_grid(tables.read_table(spark, sf, "events"), "event_type")


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly grid, one series per user."""
    return hourly_grid(tables.read_table(spark, sf, "events"), "user_id")


def runs_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of :func:`by_user` in runs."""
    return hour_runs(tables.read_table(spark, sf, "events"), "user_id")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (default all), doubles rounded for comparison."""
    names = columns or df.columns
    is_double = {f.name: isinstance(f.dataType, T.DoubleType) for f in df.schema.fields}
    return df.select(*[tidy(F.col(c)).alias(c) if is_double[c] else F.col(c) for c in names])


def long_naive(grid: DataFrame) -> DataFrame:
    return sweep.naive_predictions(with_split(grid), CFG)


def day_ahead_residuals(grid: DataFrame) -> DataFrame:
    """Load minus the load a day before, from the second day on, renumbered from 0."""
    lagged = features.add_lags_and_rolling(grid, lags=(24,), rolling=False)
    return lagged.where(F.col("pos") >= 24).select(
        "series_id", (F.col("pos") - 24).alias("pos"),
        (F.col("load") - F.col("load_lag_24h")).alias("resid"))


# --- sources ------------------------------------------------------------------

@query
def hourly_grid_by_user(spark, sf):
    return shown(by_user(spark, sf))


@query
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    schema = T.StructType([
        T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("load", T.DoubleType()), T.StructField("n_obs", T.LongType())])
    tables.write_hourly_csv(by_type(spark, sf).select("series_id", "ts", "load", "n_obs"), path)
    back = tables.read_hourly_csv(spark, path, schema)
    return shown(with_positions(back), "series_id", "ts", "pos", "n", "load", "n_obs")


@query
def cached_grid(spark, sf):
    path = scratch_path(spark, "cache")
    manifest = {"table": "events", "series": "event_type", "unit": "hour"}

    def load() -> DataFrame:
        return cache.load_or_build(spark, path, lambda: by_type(spark, sf), manifest, ts="ts")

    load()  # builds
    return shown(load())  # reads


@query
def row_contract(spark, sf):
    return quality.row_contract(by_user(spark, sf))


@query
def hour_contract(spark, sf):
    return quality.hour_contract(tables.read_table(spark, sf, "events"), "user_id")


# --- calendar, tariff, weather ------------------------------------------------

@query
def calendar_features(spark, sf):
    rows = calendar.calendar_covariates(calendar.add_cyclic(calendar.add_calendar(by_type(spark, sf))))
    rows = calendar.max_normalise(rows, "load", "load_norm")
    return shown(rows.drop("pos", "n", "load", "n_obs"))


@query
def tariff_zone(spark, sf):
    rows = calendar.add_tariff(by_type(spark, sf), use_holidays=True)
    plain = calendar.add_tariff(by_type(spark, sf), use_holidays=False)
    cols = ("tariff_zone", "tariff_enc", "price", "is_peak", "is_night")
    return shown(rows.select("series_id", "ts", *cols).join(
        plain.select("series_id", "ts", *[F.col(c).alias(f"plain_{c}") for c in cols]),
        ["series_id", "ts"]))


@query
def tariff_fallback(spark, sf):
    rows = calendar.encode_tariff(calendar.add_calendar(by_type(spark, sf)))
    return shown(rows, "series_id", "ts", "tariff_enc")


def with_weather(grid: DataFrame) -> DataFrame:
    """Stand-in weather from the event counts and loads."""
    return grid.withColumns({
        "temperature": F.col("n_obs") * 5.0, "humidity": F.least(F.col("load"), F.lit(100.0)),
        "wind_speed": F.col("n_obs") % 12 * 1.0})


@query
def weather_features(spark, sf):
    t, hum, wind = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    rows = calendar.temperature_squared(with_weather(with_split(by_type(spark, sf))),
                                        train_only=True)
    return shown(rows.select(
        "series_id", "ts", weather.heating_degree(t).alias("heating"),
        weather.cooling_degree(t).alias("cooling"), "temperature_sq",
        weather.weather_response(t, hum, wind).alias("response"),
        weather.trend_index(F.col("pos")).alias("trend"),
        weather.seasonal_drift(F.dayofyear("ts") - 1).alias("drift"),
        weather.bump(F.hour("ts"), 19.0, 2.5).alias("evening")))


# --- split, quality -------------------------------------------------------------

@query
def split(spark, sf):
    return shown(with_split(by_user(spark, sf)), "series_id", "ts", "split", "split_pos", "split_n")


@query
def head_slices(spark, sf):
    grid = by_user(spark, sf)
    parts = [head(grid, hours).groupBy("series_id").agg(
        F.lit(hours).alias("hours"), F.sum("load").alias("total")) for hours in (24, 168, 720)]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def quality_report(spark, sf):
    return shown(quality.quality_report(by_user(spark, sf)))


@query
def drift_check(spark, sf):
    return shown(quality.drift_check(with_split(by_user(spark, sf))))


@query
def alignment_check(spark, sf):
    frame = windows.forecast_frame(with_split(by_type(spark, sf)), CFG)
    test = frame.where(F.col("split") == "test")
    return quality.alignment_report(test, test.where(F.col("naive_24") > 0))


@query
def joined_scores(spark, sf):
    frame = windows.forecast_frame(with_split(by_type(spark, sf)), CFG).where(
        F.col("split") == "test")
    keys = ("series_id", "origin_idx", "h")
    pred = frame.where(F.col("naive_24") > 0).select(*keys, F.col("naive_24").alias("y_pred"))
    joined = evaluate.join_predictions(frame.select(*keys, "y"), pred)
    return shown(evaluate.score_models(joined, ("series_id",)))


# --- profiles ---------------------------------------------------------------------

@query
def describe(spark, sf):
    return shown(profile.describe(by_user(spark, sf)))


@query
def moments(spark, sf):
    return shown(profile.moments(by_user(spark, sf)))


@query
def hour_profile(spark, sf):
    return shown(profile.hour_profile(by_user(spark, sf)))


@query
def weekday_profile(spark, sf):
    return shown(profile.weekday_profile(by_user(spark, sf)))


@query
def hour_weekday_pivot(spark, sf):
    return shown(profile.hour_weekday_pivot(by_user(spark, sf)))


@query
def histogram(spark, sf):
    return shown(profile.histogram(by_type(spark, sf)))


@query
def centre(spark, sf):
    return shown(profile.centre(by_user(spark, sf)))


@query
def value_bins(spark, sf):
    return shown(profile.value_bins(by_type(spark, sf), "n_obs"))


@query
def density_2d(spark, sf):
    return profile.density_2d(by_type(spark, sf), "n_obs")


# --- features and windows -----------------------------------------------------------

@query
def minmax(spark, sf):
    grid = with_split(by_user(spark, sf))
    rows = grid.join(features.fit_minmax(grid, ("load",)), "series_id")
    low, high = F.col("load_min"), F.col("load_max")
    scaled = features.scale(F.col("load"), low, high)
    return shown(rows.select("series_id", "ts", scaled.alias("scaled"),
                             features.unscale(scaled, low, high).alias("restored")))


@query
def lags(spark, sf):
    rows = features.add_lags_and_rolling(by_user(spark, sf), rolling=False)
    return shown(rows, "series_id", "ts", "load_lag_24h", "load_lag_48h", "load_lag_168h")


@query
def rolling(spark, sf):
    rows = features.add_lags_and_rolling(with_split(by_user(spark, sf)), lags=(24,))
    return shown(rows, "series_id", "ts", "rolling_mean_24h", "rolling_std_24h")


def typed_features(spark, sf) -> DataFrame:
    return features.feature_table(with_split(by_type(spark, sf)).withColumn(
        "temperature", F.col("n_obs") * 5.0))


@query
def feature_table(spark, sf):
    return shown(typed_features(spark, sf).drop("n", "split_pos", "split_n"))


@query
def window_integrity(spark, sf):
    table = typed_features(spark, sf)
    return shown(quality.window_integrity(table, CFG, ("consumption", "temperature", "lag_168h")))


@query
def window_counts(spark, sf):
    return windows.window_counts(with_split(by_user(spark, sf)), CFG)


@query
def sliding_windows(spark, sf):
    rows = with_split(by_type(spark, sf))
    made = windows.sliding_windows(rows, CFG, ("load", "n_obs"), target="load")
    total = F.aggregate("x", F.lit(0.0), lambda a, step: a + step[0])
    return shown(made.select(
        "series_id", "split", "origin_ts", "origin_idx", F.size("x").alias("steps"),
        total.alias("x_total"), F.col("x")[0][1].alias("first_obs"),
        F.col("y")[0].alias("y_first"), F.col("y")[CFG.horizon - 1].alias("y_last")))


@query
def window_covariates(spark, sf):
    """Two-part model input: the load series next to chosen channels of the same window."""
    rows = with_split(by_type(spark, sf)).withColumn("hour", F.hour("ts"))
    channels = ("load", "n_obs", "hour")
    made = windows.pick_channels(windows.sliding_windows(rows, CFG, channels, "load"), channels,
                                 ("hour", "n_obs"))
    last = F.col("covariates")[CFG.history - 1]
    return shown(made.select(
        "series_id", "origin_ts", F.size("covariates").alias("steps"), last[0].alias("last_hour"),
        last[1].alias("last_obs"), F.col("covariates")[0][1].alias("first_obs")))


@query
def targets(spark, sf):
    frame = windows.forecast_frame(with_split(by_type(spark, sf)), CFG)
    return shown(frame, "series_id", "split", "ts", "h", "origin_idx", "y")


@query
def seasonal_naive(spark, sf):
    grid = with_split(by_type(spark, sf))
    frame = windows.forecast_frame(grid, CFG).join(
        features.fit_minmax(grid, ("load",)), "series_id")
    low, high = F.col("load_min"), F.col("load_max")
    naive = features.scale(F.col("naive_dual"), low, high)
    diff = features.scale(F.col("y"), low, high) - naive
    return shown(frame.select(
        "series_id", "ts", "h", "origin_idx", "naive_24", "naive_168", "naive_dual",
        diff.alias("y_diff"), features.reconstruct(diff, naive, low, high).alias("rebuilt")))


@query
def naive_window_lag(spark, sf):
    """The variant whose second lag is the window length."""
    frame = windows.forecast_frame(with_split(by_type(spark, sf)), CFG, weekly_lag=CFG.history)
    return shown(frame, "series_id", "ts", "h", "naive_168", "naive_dual")


@query
def lag_features(spark, sf):
    table = windows.lag_features(typed_features(spark, sf), CFG, CHANNELS).drop("pos", "y")
    # Scaled channels are small; only the ratio can be large.
    return table.select(*[
        c if c in ("series_id", "split", "origin_ts", "origin_idx")
        else (tidy if c == "load_ratio24" else tidy_small)(F.col(c)).alias(c)
        for c in table.columns])


@query
def patches(spark, sf):
    size, stride = windows.patch_geometry(CFG.history)
    made = windows.patches(windows.load_history(with_split(by_type(spark, sf)), CFG), size, stride,
                           CFG.history)
    rows = made.select("series_id", "origin_ts", F.posexplode("patches").alias("patch_no", "p"))
    return shown(rows.select("series_id", "origin_ts", "patch_no", (
        F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / size).alias("patch_mean")))


@query
def instance_norm(spark, sf):
    rows = windows.instance_norm(with_split(by_type(spark, sf)), CFG)
    return shown(rows.select(
        "series_id", "ts", "win_mean", "win_std", "normed", windows.denormalise(
            F.col("normed"), F.col("win_mean"), F.col("win_std")).alias("restored")))


@query
def latest_window(spark, sf):
    rows = windows.latest_window(by_user(spark, sf), CFG.history, ("load", "n_obs"))
    steps = rows.select("series_id", "origin_ts", F.posexplode("x").alias("step", "v"))
    return shown(steps.select("series_id", "origin_ts", "step", F.col("v")[0].alias("load"),
                              F.col("v")[1].alias("n_obs")))


@query
def covariate_selection(spark, sf):
    from ..config import COVARIATES
    return shown(typed_features(spark, sf), "series_id", "ts", "consumption", *COVARIATES)


@query
def flattened_windows(spark, sf):
    from pyspark.ml.functions import vector_to_array
    made = windows.sliding_windows(with_split(by_type(spark, sf)), CFG, ("load", "n_obs"), "load")
    flat = models.flatten_windows(made).select("series_id", "origin_ts",
                                               vector_to_array("features").alias("f"))
    return shown(flat.select("series_id", "origin_ts", F.size("f").alias("width"),
                             F.col("f")[0].alias("first"), F.array_max("f").alias("top")))


# --- evaluation -------------------------------------------------------------------------

@query
def metrics_by_model(spark, sf):
    test = long_naive(by_user(spark, sf)).where(F.col("split") == "test")
    return shown(evaluate.score_models(test))


@query
def huber(spark, sf):
    rows = long_naive(by_type(spark, sf))
    return shown(rows.groupBy("series_id", "model", "split").agg(
        scores.huber(F.col("y"), F.col("y_pred"), CFG.huber_delta).alias("huber")))


@query
def distinct_models(spark, sf):
    return long_naive(by_type(spark, sf)).select("model").distinct()


@query
def bias_correction(spark, sf):
    rows = long_naive(by_user(spark, sf))
    bias = evaluate.fit_bias(rows)
    test = evaluate.subtract_bias(rows, bias).where(F.col("split") == "test")
    return shown(evaluate.score_models(test).join(bias, ["series_id", "model"]),
                 "series_id", "model", "bias", "mae", "rmse", "mbe")


def scored_by_user(spark, sf) -> DataFrame:
    test = long_naive(by_user(spark, sf)).where(F.col("split") == "test")
    return evaluate.evaluate_models(test, CFG.horizon, first=1)


@query
def leaderboard(spark, sf):
    return shown(evaluate.leaderboard(scored_by_user(spark, sf)),
                 "series_id", "model", "rank", "composite", "mae", "rmse", "acf_24")


@query
def best_model(spark, sf):
    return shown(evaluate.best_model(scored_by_user(spark, sf), "mae"))


@query
def evaluate_flat(spark, sf):
    rows = long_naive(by_type(spark, sf)).where(F.col("split") == "train")
    return shown(evaluate.evaluate_models(rows, CFG.horizon, order="flat"),
                 "series_id", "model", "dw", "acf_24", "acf_168", "kurtosis", "composite")


@query
def backtest(spark, sf):
    return shown(evaluate.backtest(long_naive(by_type(spark, sf))))


@query
def backtest_summary(spark, sf):
    return shown(evaluate.backtest_summary(evaluate.backtest(long_naive(by_type(spark, sf)))))


@query
def fit_regime(spark, sf):
    return shown(evaluate.fit_regime(evaluate.train_val_mae(long_naive(by_user(spark, sf))),
                                     gap=0.5, floor=3.0))


@query
def prediction_spread(spark, sf):
    return shown(evaluate.prediction_spread(long_naive(by_type(spark, sf))))


@query
def forecast_views(spark, sf):
    frame = windows.forecast_frame(with_split(by_type(spark, sf)), CFG)
    keep = ("series_id", "split", "ts", "h", "y", "naive_24")
    single = windows.single_origin_view(frame, CFG).select(F.lit("single").alias("view"), *keep)
    walk = windows.walk_forward_view(frame).select(F.lit("walk").alias("view"), *keep)
    return shown(single.unionByName(walk))


@query
def error_histogram(spark, sf):
    rows = long_naive(by_type(spark, sf)).where(F.col("split") == "test")
    return shown(evaluate.error_histogram(rows))


@query
def ensemble_fixed(spark, sf):
    frame = windows.forecast_frame(with_split(by_user(spark, sf)), CFG).where(
        F.col("split") == "test")
    mixed = ensemble.weighted(frame, MEMBERS, (0.5, 0.3, 0.2))
    return shown(evaluate.score_models(mixed, ("series_id",)))


@query
def ensemble_search(spark, sf):
    frame = windows.forecast_frame(with_split(by_user(spark, sf)), CFG)
    found = ensemble.search_weights(frame, MEMBERS)
    return shown(found.select("series_id", "mae", "gap", *[
        F.col("weights")[i].alias(f"w_{m}") for i, m in enumerate(MEMBERS)]))


@query
def ensemble_scores(spark, sf):
    frame = windows.forecast_frame(with_split(by_user(spark, sf)), CFG)
    weights = ensemble.search_weights(frame, MEMBERS)
    mixed = ensemble.weighted_by_series(frame.where(F.col("split") == "test"), weights, MEMBERS)
    return shown(evaluate.score_models(mixed, ("series_id",)))


@query
def seasonal_blend(spark, sf):
    frame = windows.forecast_frame(with_split(by_type(spark, sf)), CFG)
    fitted = ensemble.fit_seasonal_blend(frame, pred="naive_dual")
    mixed = ensemble.seasonal_blend(frame.join(fitted, "series_id"), pred="naive_dual",
                                    w="w", v="v")
    test = mixed.where(F.col("split") == "test").groupBy("series_id").agg(
        scores.mae(F.col("y"), F.col("blended")).alias("test_mae"))
    return shown(fitted.join(test, "series_id"))


# --- residual analysis ---------------------------------------------------------------------

@query
def acf(spark, sf):
    return shown(residuals.acf_profile(by_type(spark, sf), "load", 200))


@query
def pacf(spark, sf):
    return shown(residuals.pacf_profile(by_type(spark, sf), "load", 50))


@query
def residual_diagnostics(spark, sf):
    return shown(residuals.residual_diagnostics(day_ahead_residuals(by_user(spark, sf))))


@query
def residual_summary(spark, sf):
    return shown(residuals.residual_summary(day_ahead_residuals(by_user(spark, sf))))


@query
def ljung_box(spark, sf):
    return shown(residuals.ljung_box(day_ahead_residuals(by_user(spark, sf))))


@query
def jarque_bera(spark, sf):
    return shown(residuals.jarque_bera(day_ahead_residuals(by_user(spark, sf))))


@query
def kpss(spark, sf):
    return shown(residuals.kpss(day_ahead_residuals(by_type(spark, sf))))


@query
def adf(spark, sf):
    return shown(residuals.adf(day_ahead_residuals(by_type(spark, sf))))


@query
def qq_points(spark, sf):
    return shown(residuals.qq_points(day_ahead_residuals(by_type(spark, sf))))


@query
def residual_tests(spark, sf):
    return shown(residuals.residual_tests(day_ahead_residuals(by_type(spark, sf))))


@query
def decomposition(spark, sf):
    return shown(decompose.seasonal_decompose(by_type(spark, sf)),
                 "series_id", "ts", "trend", "seasonal", "resid")


# --- scans and storage -----------------------------------------------------------------------

@query
def rebound(spark, sf):
    rows = by_type(spark, sf).withColumn("dsr_active", (F.col("load") > 200).cast("int"))
    return shown(scan.rebound(rows, "dsr_active"), "series_id", "ts", "rebound")


@query
def cascade(spark, sf):
    return shown(scan.cascade(by_type(spark, sf)), "series_id", "ts", "cascade")


@query
def stress(spark, sf):
    rows = calendar.max_normalise(by_type(spark, sf), "load", "ev_share")
    rows = rows.withColumn("trigger", scan.stress_trigger(
        F.col("n_obs") * 5.0, F.hour("ts"), F.col("ev_share"),
        calendar.tp.is_weekend(F.col("ts")).cast("double")))
    return shown(scan.stress(rows), "series_id", "ts", "stress_state", "stress")


@query
def dispatch(spark, sf):
    return shown(storage.dispatch(by_type(spark, sf), BATTERY),
                 "series_id", "strategy", "ts", "zone", "soc_before", "soc", "action", "grid_kwh",
                 "cost")


@query
def cumulative_savings(spark, sf):
    return shown(storage.cumulative_savings(storage.dispatch(by_type(spark, sf), BATTERY)),
                 "series_id", "strategy", "ts", "cum_saved")


@query
def tariff_cost(spark, sf):
    kpis = storage.compare_strategies(by_user(spark, sf), BATTERY)
    finite = F.when(F.col("annual_savings") > 0, F.col("payback_years"))
    return shown(kpis.withColumn("payback_years", finite).drop("order"))


@query
def best_strategy(spark, sf):
    return shown(storage.best_strategy(storage.compare_strategies(by_user(spark, sf), BATTERY)))


# --- series in runs -------------------------------------------------------------------------------

@query
def runs(spark, sf):
    return shown(runs_by_user(spark, sf).drop("lo"))


@query
def runs_dense(spark, sf):
    return shown(dense(runs_by_user(spark, sf)))


@query
def runs_describe(spark, sf):
    return shown(sparse.describe(runs_by_user(spark, sf)))


@query
def runs_moments(spark, sf):
    return shown(sparse.moments(runs_by_user(spark, sf)))


@query
def runs_hour_profile(spark, sf):
    return shown(sparse.hour_profile(sparse.week_table(runs_by_user(spark, sf))))


@query
def runs_weekday_profile(spark, sf):
    return shown(sparse.weekday_profile(sparse.week_table(runs_by_user(spark, sf))))


@query
def runs_hour_weekday_pivot(spark, sf):
    return shown(sparse.hour_weekday_pivot(sparse.week_table(runs_by_user(spark, sf))))


@query
def runs_lags(spark, sf):
    return shown(sparse.lag_values(runs_by_user(spark, sf), (1, 24, 48, 168)))


@query
def runs_acf(spark, sf):
    return shown(sparse.autocorrelation(runs_by_user(spark, sf), (1, 24, 48, 168)))


# --- windows from stored blocks -----------------------------------------------------------------

@query
def stored_windows(spark, sf):
    """All 26 channels of every window, read from blocks; reduced to means and ends in the task."""
    channels = CHANNELS
    path = scratch_path(spark, "windows")
    window_store.write_blocks(typed_features(spark, sf), CFG, channels, path)

    def reduce(x, y):
        return {**{f"{c}_mean": x[:, :, i].mean(axis=1) for i, c in enumerate(channels)},
                **{f"{c}_last": x[:, -1, i] for i, c in enumerate(channels)},
                "y_first": y[:, 0], "y_last": y[:, -1]}

    names = [*(f"{c}_mean" for c in channels), *(f"{c}_last" for c in channels), "y_first", "y_last"]
    made = window_store.map_windows(spark.read.parquet(path), CFG, channels, reduce, names)
    return made.select("series_id", "split", "origin_ts", "origin_idx",
                       *[tidy_small(F.col(c)).alias(c) for c in names])


@query
def stored_flat_windows(spark, sf):
    """All 26 channels of every window as one vector, from stored blocks."""
    path = scratch_path(spark, "windows")
    window_store.write_blocks(typed_features(spark, sf), CFG, CHANNELS, path)
    rows = window_store.read_windows(spark.read.parquet(path), CFG, CHANNELS)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "series_id", "split", "origin_ts", "origin_idx", F.size("x").alias("width"), F.size("y").alias("targets"),
        *[tidy_small(c).alias(name) for name, c in (
            ("first", F.col("x")[0]), ("top", F.array_max("x")), ("total", total / F.size("x")))])


# --- fitted models -----------------------------------------------------------------------------

def typed_model_grid(spark, sf) -> DataFrame:
    return with_split(by_type(spark, sf)).withColumn("temperature", F.col("n_obs") * 5.0)


@query
def seasonal_targets(spark, sf):
    table = models.model_table(typed_model_grid(spark, sf), replace(CFG, seasonal_diff=True), ("consumption",))
    cells = F.posexplode(F.arrays_zip("y", "naive")).alias("_at", "_c")
    return shown(table.select("series_id", "split", "origin_idx", cells).select(
        "series_id", "split", "origin_idx", (F.col("_at") + 1).alias("h"), F.col("_c.y").alias("y_diff"),
        F.col("_c.naive").alias("naive")))


@query
def ridge(spark, sf):
    table = models.model_table(typed_model_grid(spark, sf), CFG, CHANNELS)
    table = cut_lineage(table)
    model = models.fit_ridge(table, CFG, models.feature_names(CFG, CHANNELS))
    return shown(models.predict_long(model, table.where(F.col("split") == "test"), "ridge"))


@query
def gbt(spark, sf):
    table = models.model_table(typed_model_grid(spark, sf), CFG, CHANNELS)
    names = models.feature_names(CFG, CHANNELS)
    with models.held(table):
        model = models.fit_gbt(table, CFG, names, SMALL_TREES, horizons=FITTED_HORIZONS)
    return shown(models.predict_long(model, table.where(F.col("split") == "test"), "gbt"))


@query
def ridge_grid_search(spark, sf):
    table = models.model_table(typed_model_grid(spark, sf), CFG, CHANNELS)
    found, _ = sweep.grid_search("ridge", table, CFG, models.feature_names(CFG, CHANNELS),
                                 [{"alpha": a} for a in (0.1, 1.0, 10.0)])
    return shown(found)


@query
def model_comparison(spark, sf):
    return shown(sweep.compare_models(typed_model_grid(spark, sf), CFG,
                                      ("naive", "ridge", "ensemble"), CHANNELS))


@query
def history_sweep(spark, sf):
    return shown(sweep.history_sweep(typed_model_grid(spark, sf), CFG, (24, 48, 72, 96),
                                     kinds=("naive", "ridge"), channels=CHANNELS))


@query
def bundle_score(spark, sf):
    grid = typed_model_grid(spark, sf)
    table = models.model_table(grid, CFG, CHANNELS)
    names = models.feature_names(CFG, CHANNELS)
    with models.held(table):
        model = models.fit_ridge(table, CFG, names)
        bias = cut_lineage(evaluate.fit_bias(models.predict_long(model, table, "ridge")))
    path = export_bundle(model, features.scaler_params(grid), {
        "model_name": "ridge", "history": CFG.history, "horizon": CFG.horizon,
        "channels": list(CHANNELS)}, scratch_path(spark, "bundle"), bias)
    return shown(models.score_latest(load_bundle(spark, path), grid))


@query
def stage_search_score(spark, sf):
    """Features, ridge of the best alpha, original units and bias as one saved and loaded PipelineModel."""
    grid = typed_model_grid(spark, sf)
    made = stages.forecaster(CFG, CHANNELS)
    tuned = made[stages.TUNED]
    search = stages.ChronologicalValidator(made, ParamGridBuilder().addGrid(tuned.alpha, [0.1, 1.0, 10.0]).build())
    path = scratch_path(spark, "stages")
    search.fit(grid).save(path)
    return shown(stages.for_latest(PipelineModel.load(path)).transform(grid))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Grid, naive forecasts, scores, ranking: the whole path for every user."""
    return leaderboard(spark, sf)
