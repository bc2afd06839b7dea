import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadloom.config import ForecastConfig
from loadloom.functions import scores
from loadloom.operators import ensemble, evaluate, quality, sweep, windows

CFG = ForecastConfig(history=48, horizon=24)
TRUE, PRED = [50.0, 80.0, 40.0, 70.0], [53.0, 76.0, 40.0, 75.0]


def frame(spark, true, pred, model="m"):
    return spark.createDataFrame(pd.DataFrame({
        "series_id": "s", "model": model, "split": "test", "origin_idx": range(len(true)), "h": 1,
        "y": true, "y_pred": pred}))


def test_scores_by_hand(spark):
    r = evaluate.score_models(frame(spark, TRUE, PRED)).first()
    assert (r.mae, abs(r.mbe)) == (3.0, 1.0)
    assert r.rmse == pytest.approx(np.sqrt(12.5))
    assert r.wape == pytest.approx(1200 / 240) and r.r2 == pytest.approx(1 - 50 / 1000)
    assert r.mape == pytest.approx(100 * np.mean([3 / 50, 4 / 80, 0, 5 / 70]))
    assert r.smape == pytest.approx(200 * np.mean([3 / 103, 4 / 156, 0, 5 / 145]))


def test_mismatched_or_empty_input_raises(spark):
    a, b = frame(spark, TRUE[:3], PRED[:3]), frame(spark, TRUE[:2], PRED[:2])
    with pytest.raises(ValueError):
        quality.require_aligned(a, b)
    with pytest.raises(ValueError):
        quality.require_aligned(a.limit(0), b.limit(0))
    quality.require_aligned(a, a)


def test_huber_and_composite(spark):
    df = spark.createDataFrame([(0.0, 0.02), (0.0, 1.0)], "y double, p double")
    got = df.agg(scores.huber(F.col("y"), F.col("p"), 0.05).alias("v")).first().v
    assert got == pytest.approx((0.0002 + 0.05 * (1 - 0.025)) / 2)
    one = spark.range(1).select(scores.composite(F.lit(10.0), F.lit(20.0), F.lit(-0.5)).alias("a"),
                                scores.composite(F.lit(10.0), F.lit(20.0),
                                                 F.lit(None).cast("double")).alias("b")).first()
    assert one.a == pytest.approx(5 + 6 + 1) and one.b == pytest.approx(11)


@pytest.mark.parametrize("train,val,status", [
    (0.03, 0.07, "overfitting"), (0.21, 0.22, "underfitting"), (0.04, 0.05, "balanced"),
    (None, 0.1, "unknown")])
def test_fit_regime(spark, train, val, status):
    df = spark.createDataFrame([("s", "m", train, val)],
                               "series_id string, model string, train_mae double, val_mae double")
    assert evaluate.fit_regime(df).first().status == status


def test_bias_is_fitted_on_validation_and_removed(spark):
    rows = [("s", "m", sp, i, 1, 10.0, 10.0 + b) for i, (sp, b) in enumerate(
        [("val", 2.0), ("val", 4.0), ("test", 3.0), ("train", 50.0)])]
    df = spark.createDataFrame(rows, "series_id string, model string, split string, "
                               "origin_idx int, h int, y double, y_pred double")
    bias = evaluate.fit_bias(df)
    assert bias.first().bias == 3.0
    fixed = evaluate.subtract_bias(df, bias).where("split = 'test'").first()
    assert fixed.y_pred == 10.0


@pytest.mark.parametrize("n,windows_no,sizes", [
    (37, 8, [4] * 7 + [9]), (16, 8, [2] * 8), (5, 8, [5]), (45, 50, [22, 23])])
def test_backtest_blocks(spark, n, windows_no, sizes):
    df = frame(spark, [1.0] * n, [2.0] * n).withColumn("n_origins", F.lit(n).cast("bigint"))
    got = {r.window_no: r.n for r in evaluate.backtest(df, windows_no).collect()}
    assert [got[i] for i in sorted(got)] == sizes


def test_leaderboard_and_best(spark):
    rows = [("s", "b", 2.0, 5.0), ("s", "a", 2.0, 7.0), ("s", "c", None, 1.0), ("t", "a", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "series_id string, model string, composite double, mae double")
    rank = {(r.series_id, r.model): r["rank"] for r in evaluate.leaderboard(df).collect()}
    assert rank == {("s", "a"): 1, ("s", "b"): 2, ("s", "c"): 3, ("t", "a"): 1}
    best = {r.series_id: r.best_model for r in evaluate.best_model(df, "mae").collect()}
    assert best == {"s": "c", "t": "a"}


def test_evaluate_orders_residuals_in_time_and_flat(grid):
    rows = sweep.naive_predictions(grid, CFG).where("split = 'train' and model = 'naive_24'").cache()
    pdf = rows.where("series_id = 'a'").toPandas().sort_values(["origin_idx", "h"])
    pdf["r"] = pdf["y"] - pdf["y_pred"]

    def acf(r, k):
        r = r - r.mean()
        return (r[k:] * r[:-k]).sum() / (len(r) * (r.var() + 1e-12))

    for order, r in (("time", pdf[pdf["h"] == 1]["r"].to_numpy()), ("flat", pdf["r"].to_numpy())):
        got = evaluate.evaluate_models(rows, 24, order).where("series_id = 'a'").first()
        assert got.acf_24 == pytest.approx(acf(r, 24), abs=1e-9)
        assert got.dw == pytest.approx((np.diff(r) ** 2).sum() / (r ** 2).sum(), abs=1e-9)
        assert got.kurtosis == pytest.approx(((r - r.mean()) ** 4).mean() / r.var() ** 2)
        assert got.composite == pytest.approx(
            0.5 * got.mae + 0.3 * got.rmse + 0.2 * abs(got.acf_24) * got.mae)
    with pytest.raises(ValueError):
        evaluate.evaluate_models(rows, 24, "other")
    rows.unpersist()


def test_prediction_spread(spark):
    df = frame(spark, [1.0], [2.0], "a").unionByName(frame(spark, [1.0], [6.0], "b"))
    r = evaluate.prediction_spread(df).first()
    assert (r.samples, r.mean_pred, r.std_pred) == (2, 4.0, 2.0)


def test_fixed_weights_are_normalised(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    assert ensemble.weighted(df, ("a", "b"), (3.0, 1.0)).first().y_pred == 1.5


def test_weight_search_finds_the_known_blend(spark):
    rng = np.random.default_rng(5)
    parts = []
    for name, w in (("s", (0.7, 0.3, 0.0)), ("t", (0.15, 0.0, 0.85))):
        p = rng.normal(100, 30, (400, 3))
        parts.append(pd.DataFrame(p, columns=["a", "b", "c"]).assign(
            series_id=name, split="val", y=p @ np.array(w)))
    df = spark.createDataFrame(pd.concat(parts))
    got = {r.series_id: r for r in ensemble.search_weights(df, ("a", "b", "c")).collect()}
    for name, w in (("s", (0.7, 0.3, 0.0)), ("t", (0.15, 0.0, 0.85))):
        found = np.array(got[name].weights)
        assert found.sum() == pytest.approx(1) and found.min() >= 0.0009
        np.testing.assert_allclose(found, w, atol=0.02)
    table = ensemble.weight_map(ensemble.search_weights(df, ("a", "b", "c")), ("a", "b", "c"))
    assert set(table.first().weights) == {"a", "b", "c"}


def lad_on_simplex(p, y):
    """Lowest MAE by pairwise exchanges with halving steps from many starts, then polished at random."""
    rng = np.random.default_rng(0)
    k = p.shape[1]
    best = np.inf
    for start in [np.full(k, 1 / k), *rng.dirichlet(np.ones(k), 6)]:
        w, step = start, 0.2
        low = np.abs(y - p @ w).mean()
        while step > 2e-4:
            moved = False
            for d in rng.normal(size=(40, k)):
                v = np.maximum(w + step * (d - d.mean()), 0)
                v /= v.sum()
                mae = np.abs(y - p @ v).mean()
                if mae < low - 1e-12:
                    w, low, moved = v, mae, True
            step = step if moved else step / 2
        best = min(best, low)
    return best


@pytest.mark.parametrize("k", [2, 5, 6, 10])
def test_weight_search_reaches_the_minimum(spark, k):
    rng = np.random.default_rng(k)
    y = 100 + rng.normal(0, 20, 300)
    p = y[:, None] + rng.normal(0, 1, (300, k)) + rng.normal(0, 2, 300)[:, None] + rng.normal(0, 1.5, k)
    names = [f"m{i}" for i in range(k)]
    df = spark.createDataFrame(pd.DataFrame(p, columns=names).assign(series_id="s", split="val", y=y))
    got = ensemble.search_weights(df, names).first()
    assert got.mae <= lad_on_simplex(p, y) * 1.001
    assert np.abs(y - p @ np.array(got.weights)).mean() == pytest.approx(got.mae, rel=0.02)


def test_weights_of_one_member(spark):
    df = spark.createDataFrame([("s", "val", 1.0, 2.0)], "series_id string, split string, y double, a double")
    assert list(ensemble.search_weights(df, ("a",)).first().weights) == [1.0]
    with pytest.raises(ValueError):
        ensemble.search_weights(df, ())


def test_seasonal_blend_formula_and_fit(grid):
    frame_ = windows.forecast_frame(grid, CFG)
    one = ensemble.seasonal_blend(frame_, pred="naive_dual").first()
    want = 0.8 * (0.6 * one.naive_dual + 0.4 * one.naive_24) + 0.2 * one.naive_168
    assert one.blended == pytest.approx(want)
    fitted = {r.series_id: r for r in
              ensemble.fit_seasonal_blend(frame_, pred="naive_dual", steps=4).collect()}
    val = frame_.where("split = 'val' and series_id = 'a'").toPandas()
    trials = [np.abs(val["y"] - (v * (w * val["naive_dual"] + (1 - w) * val["naive_24"])
                                 + (1 - v) * val["naive_168"])).mean()
              for w in np.linspace(0, 1, 5) for v in np.linspace(0, 1, 5)]
    assert fitted["a"].mae == pytest.approx(min(trials), abs=1e-6)
