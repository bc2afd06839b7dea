import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from loadloom.config import ForecastConfig
from loadloom.operators import evaluate, features, models, stages, sweep
from loadloom.operators.linear import Ridge
from loadloom.sources.bundle import export_bundle, load_bundle

CFG = ForecastConfig(history=30, horizon=3)
CH = ("consumption", "hour_sin", "temperature")


def forecasts(df):
    return {(r.series_id, r.h): r.y_pred for r in df.collect()}


@pytest.mark.parametrize("seasonal", [False, True])
def test_saved_pipeline_equals_the_bundle(spark, grid, tmp_path, seasonal):
    cfg = ForecastConfig(history=30, horizon=3, seasonal_diff=seasonal)
    fitted = Pipeline(stages=stages.forecaster(cfg, CH)).fit(grid)
    fitted.save(str(tmp_path / "stages"))
    loaded = PipelineModel.load(str(tmp_path / "stages"))
    got = forecasts(stages.for_latest(loaded).transform(grid))

    table = models.model_table(grid, cfg, CH)
    model = models.fit_ridge(table, cfg, models.feature_names(cfg, CH))
    bias = evaluate.fit_bias(models.predict_long(model, table, "ridge"))
    path = export_bundle(model, features.scaler_params(grid), {
        "model_name": "ridge", "history": 30, "horizon": 3, "channels": list(CH), "seasonal_diff": seasonal},
        str(tmp_path / "bundle"), bias)
    want = forecasts(models.score_latest(load_bundle(spark, path), grid))
    assert got.keys() == want.keys() and len(got) == 6
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    with pytest.raises(ValueError, match="fewer than"):
        stages.for_latest(loaded).transform(grid.withColumn("n", F.lit(20)))


def test_validator_picks_what_the_search_picks(grid):
    made = stages.forecaster(CFG, CH)
    alphas = [1e5, 1.0, 1e-3]
    found = stages.ChronologicalValidator(
        made[:4], ParamGridBuilder().addGrid(made[stages.TUNED].alpha, alphas).build()).fit(grid)
    table = models.model_table(grid, CFG, CH)
    rows, best = sweep.grid_search("ridge", table, CFG, models.feature_names(CFG, CH), [{"alpha": a} for a in alphas])
    want = {r.params: r.val_mae for r in rows.collect()}
    assert [p["alpha"] for p, _ in found.validation] == alphas
    for p, error in found.validation:
        assert error == pytest.approx(want[str(p)], rel=1e-9)
    assert min(found.validation, key=lambda v: v[1])[0] == best and best["alpha"] != 1e5
    assert len(found.stages) == 4


def test_all_alphas_from_one_pass(grid, monkeypatch):
    from loadloom.operators import linear
    passes = []
    plain = linear.cross_products
    monkeypatch.setattr(linear, "cross_products", lambda *a, **k: passes.append(1) or plain(*a, **k))
    table = models.model_table(grid, CFG, CH).select("split", "load_t0", "load_t1", "y")
    est = Ridge(inputs=["load_t0", "load_t1"], steps=[1, 3], split="train")
    made = dict(est.fitMultiple(table, [{est.alpha: a} for a in (0.1, 2.0)] + [{}]))
    assert len(passes) == 1 and sorted(made) == [0, 1, 2]
    for i, a in enumerate((0.1, 2.0, 1.0)):
        alone = est.copy({est.alpha: a}).fit(table)
        for x, y in zip(alone.getOrDefault("weights"), made[i].getOrDefault("weights"), strict=True):
            assert x == pytest.approx(y)
    both = dict(est.fitMultiple(table, [{est.steps: [2]}]))
    assert both[0].getOrDefault("steps") == [2]


def test_grids_that_cannot_be_searched():
    made = stages.forecaster(CFG, CH)
    with pytest.raises(ValueError, match="no parameter maps"):
        stages.ChronologicalValidator(made, [])
    with pytest.raises(ValueError, match="one stage"):
        stages.ChronologicalValidator(made, [{made[1].history: 24, made[2].alpha: 1.0}])
    with pytest.raises(ValueError, match="one stage"):
        stages.ChronologicalValidator(made[:2], [{made[2].alpha: 1.0}])
