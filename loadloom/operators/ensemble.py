"""Blends of several forecasts, with weights picked on the validation rows.

A pass of the search is one aggregation that leaves a few sums per series. Candidates of
the seasonal blend are columns of one aggregation, combined inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

MIN_WEIGHT = 1e-3
#: An error of this share of the truth's mean size counts as none.
NO_ERROR = 1e-5
#: Floor under |error| in the last passes, as a share of the MAE; lower ones take more passes.
LOWEST_FLOOR = 1e-3
#: Distinct cells of a series that one task may hold, and the passes it makes over them at most.
WHOLE_CELLS = 50_000
WHOLE_PASSES = 200


def weighted(frame: DataFrame, members: Sequence[str], weights: Sequence[float],
             out: str = "y_pred") -> DataFrame:
    """Weighted mean of prediction columns with fixed weights, normalised to sum 1."""
    total = float(sum(weights))
    mix = sum((F.lit(w / total) * F.col(m) for m, w in zip(members, weights)), F.lit(0.0))
    return frame.withColumn(out, mix)


def weighted_by_series(frame: DataFrame, weights: DataFrame, members: Sequence[str],
                       out: str = "y_pred") -> DataFrame:
    """Weighted mean with the weight array of each series."""
    mix = sum((F.col("weights")[i] * F.col(m) for i, m in enumerate(members)), F.lit(0.0))
    return (frame.join(weights.select("series_id", "weights"), "series_id")
            .withColumn(out, mix).drop("weights"))


def side_by_side(long: DataFrame, members: Sequence[str]) -> DataFrame:
    """Long predictions with one column per member; only cells that every member has.

    The truth is no key: models that scale it back may differ in its last digits.
    """
    keys = [c for c in long.columns if c not in ("model", "y_pred", "y")]
    cells = [F.max("y").alias("y")] + [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in members]
    wide = long.where(F.col("model").isin(list(members))).groupBy(*keys).agg(*cells)
    return wide.dropna(subset=list(members))


def _simplex_minimum(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Weights w >= 0 with sum 1 that minimise w'Gw - 2 c'w, by an active set."""
    k = len(cross)
    ridge = 1e-10 * max(float(np.trace(gram)), 1e-300) / k
    whole, right = np.ones((k + 1, k + 1)), np.ones(k + 1)
    whole[:k, :k], whole[k, k], right[:k] = gram, 0.0, cross
    whole.flat[:k * (k + 2):k + 2] += ridge
    free = np.ones(k, bool)
    for _ in range(4 * k):
        idx = np.flatnonzero(free)
        n = len(idx)
        own = np.append(idx, k)
        system, goal = (whole, right) if n == k else (whole[own[:, None], own], right[own])
        solved = np.linalg.lstsq(system, goal, rcond=None)[0]
        if solved[:n].min() < -1e-12 and n > 1:
            free[idx[int(np.argmin(solved[:n]))]] = False
            continue
        w = np.zeros(k)
        w[idx] = solved[:n]
        slack = gram @ w - cross + solved[n]
        worst = int(np.argmin(np.where(free, np.inf, slack)))
        if free.all() or slack[worst] >= -1e-9 * (1 + np.abs(cross).max()):
            break
        free[worst] = True
    w = np.maximum(w if n else np.ones(k), 0.0)
    return w / w.sum()


def _advance(sums: np.ndarray, now: np.ndarray, best: np.ndarray, low: float | None, bound: float | None) -> tuple:
    """Next weights, best ones, their error, its lower bound, relative gain and gap from the sums of a pass."""
    k = len(now)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    squares, cross = sums[:len(pairs)], sums[len(pairs):len(pairs) + k]
    pulled, (along, total, error, size) = sums[len(pairs) + k:-4], sums[-4:]
    mae, gain = error / total, 0.0
    if low is None or np.isnan(low) or mae < low:
        gain = np.inf if low is None or np.isnan(low) else (low - mae) / max(low, 1e-300)
        best, low = now, mae
    # No weights on the simplex have a lower error: any signs of the errors bound it from below.
    bound = np.fmax(0.0 if bound is None else bound, (along - pulled.max()) / total)
    gap = (low - bound) / max(low, NO_ERROR * size / total, 1e-300)
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, squares):
        gram[i, j] = gram[j, i] = x
    new = _simplex_minimum(gram, cross) if np.isfinite(sums).all() and gram.any() else now
    return new, best, float(low), float(bound), float(gain), float(gap) if np.isfinite(gap) else None


_STATE = ["series_id", "weights", "best", "best_mae", "bound", "gain", "gap"]


def _step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Next state of every series from the sums of a pass; a few numbers per series."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            new, best, *rest = _advance(np.array(row.sums, float), np.array(row.weights), np.array(row.best),
                                        row.best_mae, row.bound)
            out.append((row.series_id, new.tolist(), best.tolist(), *rest))
        yield pd.DataFrame(out, columns=_STATE)


def _passes(p: np.ndarray, t: np.ndarray, m: np.ndarray, tolerance: float) -> tuple:
    """All passes over the forecasts, truths and multiplicities of one series; its state without the name."""
    k = p.shape[1]
    now = best = np.full(k, 1 / k)
    low, bound, floor = None, 0.0, 1.0
    total, truth = m.sum(), m @ np.abs(t)
    for step in range(WHOLE_PASSES):
        e = t - p @ now
        size = np.abs(e)
        pull = m / np.maximum(size, max((low or 0.0) * floor, 1e-300)) if step else m
        sign = pull * e if step else m * np.sign(e)
        gram = p.T @ (p * pull[:, None])
        sums = np.concatenate([gram[np.tril_indices(k)] if k > 3 else [gram[i, j] for i in range(k) for j in range(i + 1)],
                               p.T @ (pull * t), p.T @ sign, [sign @ t, total, m @ size, truth]])
        now, best, low, bound, gain, gap = _advance(sums, now, best, low, bound)
        if k == 1 or gap is None or gap <= tolerance:
            break
        floor = max(LOWEST_FLOOR, floor / 4)
    return now.tolist(), best.tolist(), low, bound, gain, gap


def _whole_series(members: Sequence[str], y: str, tolerance: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """All passes over the cells of series of bounded size, whose rows lie together; one is held at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # parts of the last series, which may go on in the next batch

        def solved() -> list[tuple]:
            if not held:
                return []
            p, t, m = (np.concatenate([part[i] for part in held]) for i in (1, 2, 3))
            # One memory layout whatever the batches were, so that sums agree to the last bit.
            return [(held[0][0], *_passes(np.asfortranarray(p), t, m, tolerance))]

        for pdf in batches:
            if not len(pdf):
                continue
            names = pdf["series_id"].to_numpy()
            p, t, m = pdf[list(members)].to_numpy(float), pdf[y].to_numpy(float), pdf["_m"].to_numpy(float)
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            out = []
            for at, end in zip(starts, starts[1:]):
                if held and held[0][0] != names[at]:
                    out += solved()
                    held.clear()
                held.append((names[at], p[at:end], t[at:end], m[at:end]))
            if out:
                yield pd.DataFrame(out, columns=_STATE)
        if held:
            yield pd.DataFrame(solved(), columns=_STATE)

    return run


def search_weights(frame: DataFrame, members: Sequence[str], y: str = "y", split: str = "val",
                   tolerance: float = 2e-3, most_passes: int = 40, whole: int = WHOLE_CELLS) -> DataFrame:
    """(series_id, weights, mae, gap): member weights that minimise the validation MAE.

    Cells with the same truth and forecasts are one row with a multiplicity, so forecasts that do not depend on the
    step ahead cost one row per hour. Iteratively reweighted least squares: a pass sums, per series, the
    members' cross products weighted by 1 / |error| and solves a small problem on the simplex; the same
    steps serve any number of members. The floor under |error| falls from pass to pass.

    The weighted errors are signs between -1 and 1, so the same pass gives a lower bound of the smallest MAE
    (the dual problem's value). ``gap`` is what the MAE found lies above the best bound, relative to itself. A series
    is done when its gap is at most ``tolerance``, or when a pass at the lowest floor gains less than a tenth of
    that, or after ``most_passes``; ``gap`` says how good the result is then. Series of at most ``whole`` distinct
    cells go through the same passes inside a task, in one job for all of them. The best weights met are kept. A pass is one aggregation, written to the checkpoint folder: this function runs
    jobs. At the end every weight is at least 0.001 and they sum to 1.
    """
    k = len(members)
    if not k:
        raise ValueError("an ensemble needs at least one member")
    rows = cut_lineage(frame.where(F.col("split") == split).groupBy("series_id", y, *members).agg(
        F.count(F.lit(1)).alias("_m")))
    equal, unknown = F.array(*[F.lit(1.0 / k)] * k), F.lit(None).cast("double")
    sizes = cut_lineage(rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("_cells")))
    small, large = (sizes.where(c).select("series_id") for c in (F.col("_cells") <= whole, F.col("_cells") > whole))
    schema = ("series_id {}, weights array<double>, best array<double>, best_mae double, bound double, "
              "gain double, gap double").format(rows.schema["series_id"].dataType.simpleString())
    # Few bytes are many passes: a fixed number of tasks, which adaptive execution does not merge. The hash keeps it
    # apart from the partitioning of the join, with which it would be left out.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_once = cut_lineage(rows.join(small, "series_id").repartition(tasks, F.xxhash64("series_id")).sortWithinPartitions(
        "series_id").mapInPandas(_whole_series(members, y, tolerance), schema))
    rows = rows.join(large, "series_id", "left_semi")
    state = large.select(
        "series_id", equal.alias("weights"), equal.alias("best"), unknown.alias("best_mae"), F.lit(0.0).alias("bound"),
        unknown.alias("gain"), F.lit(float("inf")).alias("gap"))
    now = sum((F.col("weights")[i] * F.col(m) for i, m in enumerate(members)), F.lit(0.0))
    floor, going = 1.0, f"gap > {tolerance!r}"
    for step in range(most_passes if large.take(1) else 0):
        # Series whose gap is small enough, or cannot be told, or that gain no more take no further part.
        still = state.where(going)
        mixed = rows.join(still.select("series_id", "weights", "best_mae"), "series_id").withColumn("_e", F.col(y) - now)
        size = F.abs("_e")
        least = F.greatest(F.coalesce("best_mae", F.lit(1.0)) * floor, F.lit(1e-300))
        mixed = mixed.withColumn("_p", F.col("_m") / F.greatest(size, least) if step else F.col("_m").cast("double"))
        sign = F.col("_p") * F.col("_e") if step else F.col("_m") * F.signum("_e")
        cells = [F.col("_p") * F.col(a) * F.col(b) for i, a in enumerate(members) for b in members[:i + 1]]
        cells += [F.col("_p") * F.col(y) * F.col(m) for m in members]
        cells += [sign * F.col(m) for m in members]
        cells += [sign * F.col(y), F.col("_m").cast("double"), F.col("_m") * size, F.col("_m") * F.abs(F.col(y))]
        sums = mixed.groupBy("series_id").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(cells)]).select(
            "series_id", F.array(*[F.col(f"_s{i}") for i in range(len(cells))]).alias("sums"))
        moved = sums.join(still.select("series_id", "weights", "best", "best_mae", "bound"), "series_id").mapInPandas(
            _step, schema)
        state = cut_lineage(moved.unionByName(state.where(f"gap IS NULL OR NOT ({going})")))
        if floor == LOWEST_FLOOR:
            going = f"gap > {tolerance!r} AND gain > {tolerance / 10!r}"
        if k == 1 or not state.where(going).take(1):
            break
        floor = max(LOWEST_FLOOR, floor / 4)
    floored = F.transform("best", lambda w: F.greatest(w, F.lit(MIN_WEIGHT)))
    total = F.aggregate(floored, F.lit(0.0), lambda a, w: a + w)
    return state.unionByName(at_once).select("series_id", F.transform(floored, lambda w: w / total).alias("weights"),
                        F.col("best_mae").alias("mae"), "gap")


def weight_map(weights: DataFrame, members: Sequence[str]) -> DataFrame:
    """Weights as a map from member name, rounded to four digits."""
    names = F.array(*[F.lit(m) for m in members])
    rounded = F.transform("weights", lambda w: F.round(w, 4))
    return weights.select("series_id", F.map_from_arrays(names, rounded).alias("weights"))


def seasonal_blend(frame: DataFrame, pred: str = "y_pred", daily: str = "naive_24",
                   weekly: str | None = "naive_168", w: float | str = 0.60,
                   v: float | str = 0.80, out: str = "blended") -> DataFrame:
    """w·pred + (1−w)·daily, then v·that + (1−v)·weekly; weights are numbers or columns."""
    w = F.lit(w) if isinstance(w, float) else F.col(w)
    v = F.lit(v) if isinstance(v, float) else F.col(v)
    mix = w * F.col(pred) + (1.0 - w) * F.col(daily)
    if weekly:
        mix = v * mix + (1.0 - v) * F.col(weekly)
    return frame.withColumn(out, mix)


def fit_seasonal_blend(frame: DataFrame, pred: str = "y_pred", daily: str = "naive_24",
                       weekly: str | None = "naive_168", y: str = "y", split: str = "val",
                       steps: int = 10) -> DataFrame:
    """(series_id, w, v, mae): the blend weights with the lowest validation MAE."""
    grid = [(i / steps, j / steps) for i in range(steps + 1)
            for j in (range(steps + 1) if weekly else [steps])]

    def score(w: float, v: float, name: str) -> Column:
        mix = f"{w!r}D * {pred} + {1.0 - w!r}D * {daily}"
        if weekly:
            mix = f"{v!r}D * ({mix}) + {1.0 - v!r}D * {weekly}"
        return F.expr(f"avg(abs({y} - ({mix})))").alias(name)

    scored = frame.where(F.col("split") == split).groupBy("series_id").agg(
        *[score(w, v, f"_c{i}") for i, (w, v) in enumerate(grid)])
    options = ", ".join(f"named_struct('mae', round(_c{i}, 9), 'i', {i}, 'w', {w!r}D, 'v', {v!r}D)"
                        for i, (w, v) in enumerate(grid))
    return scored.select("series_id", F.expr(f"array_min(array({options}))").alias("b")).select(
        "series_id", "b.w", "b.v", "b.mae")
