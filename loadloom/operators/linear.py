"""Ridge regression of all steps ahead from one pass over the rows.

A task reduces its rows to the cross products of (1, features, targets); Spark adds them up, and
the driver sees (features + 1) x (features + steps + 1) numbers whatever the number of rows. The
weights of every step and of every alpha are solved from them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

#: Spread of a feature, relative to its size, below which it counts as constant.
CONSTANT = 1e-9


@dataclass
class CrossProducts:
    """Sums over the train rows: ``gram`` = X'X and ``cross`` = X'Y of centred columns."""

    n: int
    x_mean: np.ndarray
    y_mean: np.ndarray
    gram: np.ndarray
    cross: np.ndarray

    def weights(self, alphas: Sequence[float]) -> list[np.ndarray]:
        """Per alpha the weights (features x steps) that minimise Σ r² + α‖w‖². Constant features get 0. All
        steps share a factorisation. Features differ in size by many powers of ten, so the equations are brought
        to a unit diagonal first; without a penalty they are solved by least squares."""
        out = []
        for alpha in alphas:
            system = self.gram + alpha * np.eye(len(self.gram))
            diagonal = np.diag(system)
            d = np.where(diagonal > 0, 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0)), 0.0)
            scaled, right = system * np.outer(d, d), self.cross * d[:, None]
            if alpha > 0:
                np.fill_diagonal(scaled, 1.0)
                solved = np.linalg.solve(scaled, right)
            else:
                solved = np.linalg.lstsq(scaled, right, rcond=1e-12)[0]
            out.append(solved * d[:, None])
        return out


def cross_products(rows: DataFrame, names: Sequence[str], steps: Sequence[int], target: str = "y") -> CrossProducts:
    """One aggregation over ``rows``; ``target`` is the array of the steps' targets. Rows with a
    missing value anywhere are left out."""
    names, p, h = list(names), len(names), len(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, 1 + p + h))
        for batch in batches:
            flat = batch.column(p).flatten().to_numpy(zero_copy_only=False).astype(float)
            z = np.column_stack([np.ones(batch.num_rows), *(
                batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)), flat.reshape(-1, h)])
            z = z[np.isfinite(z).all(axis=1)]
            total += z[:, :p + 1].T @ z
        if total[0, 0]:
            i = np.repeat(np.arange(p + 1), 1 + p + h)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(
                np.tile(np.arange(1 + p + h), p + 1), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    wanted = F.array(*[F.get(F.col(target), F.lit(s - 1)).cast("double") for s in steps])
    sums = rows.select(*[F.col(c).cast("double") for c in names], wanted.alias("_y")).mapInArrow(
        run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((p + 1, 1 + p + h))
    total[sums["i"], sums["j"]] = sums["v"]
    n = total[0, 0]
    if not n:
        raise ValueError("no complete train rows")
    mean = total[0] / n
    centred = total[1:, 1:] - n * np.outer(mean[1:p + 1], mean[1:])
    gram, cross = centred[:, :p], centred[:, p:]
    size = total[np.arange(1, p + 1), np.arange(1, p + 1)]
    fixed = np.diag(gram) <= max(CONSTANT ** 2, 4 * np.finfo(float).eps) * size
    gram[fixed], gram[:, fixed], cross[fixed] = 0.0, 0.0, 0.0
    return CrossProducts(int(n), mean[1:p + 1], mean[p + 1:], (gram + gram.T) / 2, cross)


class LinearSteps(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Linear forecasts ``pred_h`` of all its steps ahead, one matrix product per Arrow batch."""

    inputs = Param(Params._dummy(), "inputs", "feature columns", TypeConverters.toListString)
    steps = Param(Params._dummy(), "steps", "steps ahead", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "per step the weights of the features", TypeConverters.toListListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "per step", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputs=None, steps=None, weights=None, intercepts=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def size(self) -> int:
        """Weights and intercepts."""
        return sum(map(len, self.getOrDefault(self.weights))) + len(self.getOrDefault(self.intercepts))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, steps = self.getOrDefault(self.inputs), self.getOrDefault(self.steps)
        w, base = np.array(self.getOrDefault(self.weights)).T, np.array(self.getOrDefault(self.intercepts))

        @F.pandas_udf("array<double>")
        def forecast(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.array(x.tolist(), float).reshape(len(x), len(w)) @ w + base))

        x = F.array(*[F.col(c).cast("double") for c in names])
        wide = dataset.select("*", forecast(x).alias("_forecast"))
        return wide.withColumns({f"pred_{s}": F.get("_forecast", F.lit(i)) for i, s in enumerate(steps)}).drop("_forecast")


def linear_steps(products: CrossProducts, names: Sequence[str], steps: Sequence[int],
                 alphas: Sequence[float]) -> list[LinearSteps]:
    """The fitted model of every alpha."""
    return [LinearSteps(inputs=list(names), steps=list(steps), weights=w.T.tolist(),
                        intercepts=(products.y_mean - products.x_mean @ w).tolist())
            for w in products.weights(alphas)]


class Ridge(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of :class:`LinearSteps` on rows with the feature columns and the array ``y`` of targets.

    With ``split`` only the rows of that split are learned from.
    """

    inputs, steps = LinearSteps.inputs, LinearSteps.steps
    alpha = Param(Params._dummy(), "alpha", "penalty α of Σ r² + α‖w‖²", TypeConverters.toFloat)
    split = Param(Params._dummy(), "split", "rows to learn from; empty: all", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputs=None, steps=None, alpha=1.0, split=""):
        super().__init__()
        self._setDefault(alpha=1.0, split="")
        self._set(**self._input_kwargs)

    def _solve(self, dataset: DataFrame, alphas: Sequence[float]) -> list[LinearSteps]:
        names, steps, split = (self.getOrDefault(p) for p in (self.inputs, self.steps, self.split))
        rows = dataset.where(F.col("split") == split) if split else dataset
        return linear_steps(cross_products(rows, names, steps), names, steps, alphas)

    def _fit(self, dataset: DataFrame) -> LinearSteps:
        return self._solve(dataset, [self.getOrDefault(self.alpha)])[0]

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, LinearSteps]]:
        """A model per parameter map; maps that name nothing but ``alpha`` share one pass over the rows."""
        if not paramMaps or any(set(m) - {self.alpha} for m in paramMaps):
            return super().fitMultiple(dataset, paramMaps)
        return enumerate(self._solve(dataset, [m.get(self.alpha, self.getOrDefault(self.alpha)) for m in paramMaps]))
