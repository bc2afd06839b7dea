import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel

from loadloom.operators import ensemble, linear, models

NAMES = ("a", "b", "c", "d")


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 1, (n, 3)) * [1, 1e3, 1e-3]
    x = np.column_stack([x, np.full(n, 7.5)])
    y = x @ rng.normal(0, 1, (4, 3)) * [1, 2, 3] + rng.normal(0, 1, (n, 3))
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame(pd.DataFrame([(*a, *b) for a, b in zip(x.tolist(), y.tolist())], columns=[
        *NAMES, "y1", "y2", "y3"])).selectExpr(*NAMES, "array(y1, y2, y3) AS y").repartition(5)


@pytest.mark.parametrize("alpha", [0.0, 0.1, 50.0])
def test_one_pass_gives_every_step_and_alpha(spark, alpha):
    x, y = rows()
    got = linear.cross_products(frame(spark, x, y), NAMES, [1, 3])
    w = got.weights([0.3, alpha])[1]
    xc, yc = x - x.mean(0), y[:, [0, 2]] - y[:, [0, 2]].mean(0)
    want = np.linalg.lstsq(np.vstack([xc, np.sqrt(alpha) * np.eye(4)]), np.vstack([yc, np.zeros((4, 2))]), rcond=None)[0]
    assert got.n == 400 and (w[3] == 0).all()
    np.testing.assert_allclose(xc @ w, xc @ want, atol=1e-6)
    # The weights are stationary: X'(y - Xw) = alpha w.
    np.testing.assert_allclose(xc.T @ (yc - xc @ w), alpha * w, atol=1e-5 * np.abs(xc.T @ yc).max())


def test_incomplete_rows_are_left_out_and_none_raise(spark):
    x, y = rows(50)
    df = spark.createDataFrame(
        [(*map(float, a), list(map(float, b))) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0, [1.0, 1.0, 1.0]),
                                                                         (1.0, 1.0, 1.0, 1.0, [1.0])],
        "a double, b double, c double, d double, y array<double>")
    assert linear.cross_products(df, NAMES, [1, 2, 3]).n == 50
    with pytest.raises(ValueError):
        linear.cross_products(df.limit(0), NAMES, [1])


def test_estimator_saves_and_loads(spark, tmp_path):
    x, y = rows()
    df = frame(spark, x, y)
    model = linear.Ridge(inputs=list(NAMES), steps=[2, 1], alpha=2.0).fit(df)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert models.fitted_horizons(again) == [2, 1] and model.size == 10
    a, b = (m.transform(df).select("a", "pred_1", "pred_2").orderBy("a").toPandas() for m in (model, again))
    pd.testing.assert_frame_equal(a, b)
    assert list(a.columns) == ["a", "pred_1", "pred_2"]


def test_patience_sees_past_a_worse_round():
    errors = [5, 4, 4.5, 4.2, 3, 3.5, 3.4, 3.3, 3.2]
    assert models.best_round(errors, 2) == (2, True)
    assert models.best_round(errors, 3) == (5, True)
    assert models.best_round(errors, 9) == (5, False)
    assert models.best_round([1.0], 1) == (1, False)


def test_gap_bounds_the_error_and_repeats_change_nothing(spark):
    rng = np.random.default_rng(3)
    y = 100 + rng.normal(0, 20, 200)
    p = y[:, None] + rng.normal(0, 3, (200, 3)) + rng.normal(0, 2, 3)
    data = pd.DataFrame(p, columns=list("abc")).assign(series_id="s", split="val", y=y)
    once = ensemble.search_weights(spark.createDataFrame(data), list("abc")).first()
    many = ensemble.search_weights(spark.createDataFrame(pd.concat([data] * 5)), list("abc"), whole=0).first()
    grid = [(i / 50, j / 50) for i in range(51) for j in range(51 - i)]
    lattice = min(np.abs(y - p @ [a, b, 1 - a - b]).mean() for a, b in grid)
    assert -1e-9 <= once.gap <= 2e-3 and once.mae * (1 - once.gap) <= lattice + 1e-9 and once.mae <= lattice * 1.001
    assert many.mae == pytest.approx(once.mae, rel=2e-3)
