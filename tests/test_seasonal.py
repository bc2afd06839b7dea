from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import hourly_pandas, to_spark
from loadloom.config import ForecastConfig
from loadloom.operators import evaluate, features, models
from loadloom.sources.bundle import export_bundle, load_bundle
from loadloom.sources.grid import with_split

CHANNELS = ("consumption", "hour_sin")
DAILY = ForecastConfig(history=48, horizon=24, seasonal_diff=True)
DUAL = ForecastConfig(history=192, horizon=24, seasonal_diff=True)


@pytest.fixture(scope="module")
def grid(spark):
    pdf = hourly_pandas(80, ("a",))
    pdf.loc[pdf["pos"] > 1700, "load"] -= 60  # below the train minimum: scaled values under 0
    return with_split(to_spark(spark, pdf)).cache()


def scaled_load(grid):
    pdf = grid.toPandas().sort_values("pos")
    train = pdf[pdf["split"] == "train"]["load"]
    return pdf, (pdf["load"].to_numpy() - train.min()) / (train.max() - train.min()), train


def naive_by_hand(x, at, cfg):
    """Naive forecasts of the steps after row ``at``, as the definition has them."""
    day = [max(x[at + h - cfg.horizon], 0) for h in range(1, cfg.horizon + 1)]
    if cfg.history < 168:
        return np.array(day)
    far = [max(x[at + h - cfg.history], 0) for h in range(1, cfg.horizon + 1)]
    return 0.6 * np.array(day) + 0.4 * np.array(far)


@pytest.mark.parametrize("cfg", [DAILY, DUAL])
def test_targets_are_differences(grid, cfg):
    _, x, _ = scaled_load(grid)
    rows = models.model_table(grid, cfg, CHANNELS).select("pos", "y", "naive").collect()
    plain = models.model_table(grid, replace(cfg, seasonal_diff=False), CHANNELS)
    assert len(rows) == plain.count() > 0 and "naive" not in plain.columns
    for r in rows:
        naive = naive_by_hand(x, r.pos, cfg)
        np.testing.assert_allclose(r.naive, naive, atol=1e-12)
        np.testing.assert_allclose(r.y, x[r.pos + 1:r.pos + 25] - naive, atol=1e-12)


@pytest.mark.parametrize("cfg", [DAILY, DUAL])
def test_ridge_on_differences_equals_direct_computation(grid, cfg):
    _, _, train = scaled_load(grid)
    low, width = train.min(), train.max() - train.min()
    table = models.model_table(grid, cfg, CHANNELS)
    names = models.feature_names(cfg, CHANNELS)
    model = models.fit_ridge(table, cfg, names, alpha=5.0)
    got = models.predict_long(model, table, "ridge").toPandas()
    pdf = table.toPandas().sort_values("pos")
    x, y, naive = pdf[names].to_numpy(float), np.stack(pdf["y"]), np.stack(pdf["naive"])
    fit = (pdf["split"] == "train").to_numpy()
    mx, my = x[fit].mean(0), y[fit].mean(0)
    z = x[fit] - mx
    w = np.linalg.solve(z.T @ z + 5.0 * np.eye(len(names)), z.T @ (y[fit] - my))
    want = np.maximum((x - mx) @ w + my + naive, 0) * width + low
    truth = np.maximum(y + naive, 0) * width + low
    got = got.sort_values(["origin_ts", "h"])
    np.testing.assert_allclose(got["y_pred"].to_numpy().reshape(want.shape), want, rtol=1e-6)
    np.testing.assert_allclose(got["y"].to_numpy().reshape(want.shape), truth, rtol=1e-9)
    assert got["y_pred"].min() >= low - 1e-9 and got["y"].min() == pytest.approx(low)


def test_bundle_keeps_differences_and_bias(spark, grid, tmp_path):
    table = models.model_table(grid, DUAL, CHANNELS)
    model = models.fit_ridge(table, DUAL, models.feature_names(DUAL, CHANNELS))
    bias = evaluate.fit_bias(models.predict_long(model, table, "ridge"))
    path = export_bundle(model, features.scaler_params(grid), {
        "model_name": "ridge", "history": 192, "horizon": 24, "channels": list(CHANNELS), "seasonal_diff": True},
        f"file://{tmp_path}/bundle", bias)
    got = models.score_latest(load_bundle(spark, path), grid).toPandas().sort_values("h")
    last = models.latest_table(grid, DUAL, features.scaler_params(grid), CHANNELS)
    _, x, _ = scaled_load(grid)
    np.testing.assert_allclose(last.first().naive, naive_by_hand(np.r_[x, np.zeros(24)], len(x) - 1, DUAL), atol=1e-12)
    raw = models.predict_long(model, last, "ridge", with_truth=False).toPandas().sort_values("h")
    off = bias.first().bias
    assert off != 0
    np.testing.assert_allclose(got["y_pred"], raw["y_pred"] - off)


def test_a_history_shorter_than_the_horizon_is_refused(grid):
    with pytest.raises(ValueError):
        models.model_table(grid, ForecastConfig(history=12, horizon=24, seasonal_diff=True), CHANNELS)
