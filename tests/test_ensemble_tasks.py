"""The weight search of short series: spread over tasks, and whatever the batches the rows come in."""

import numpy as np
import pandas as pd

from loadloom.operators import ensemble

MEMBERS = ("a", "b", "c")


def cells(series: int, n: int = 30) -> pd.DataFrame:
    rng = np.random.default_rng(4)
    size = series * n
    a, b = rng.exponential(20, (2, size)).round(2)
    y = (0.7 * a + 0.2 * b + rng.normal(0, 2, size)).round(2)
    return pd.DataFrame({"series_id": [f"s{i // n:03d}" for i in range(size)], "y": y, "a": a, "b": b, "c": 0.6 * a + 0.4 * b,
                         "_m": 1 + np.arange(size) % 3})


def test_a_series_cut_by_batches_is_one_series():
    rows, run = cells(7), ensemble._whole_series(MEMBERS, "y", 2e-3)
    want = pd.concat([pd.concat(list(run(iter([part]))))
                      for _, part in rows.groupby("series_id")], ignore_index=True)
    assert want.series_id.tolist() == [f"s{i:03d}" for i in range(7)] and (want.gap <= 2e-3).all()
    for size in (1, 13, 30, 77, 500):
        got = pd.concat(list(run(rows.iloc[i:i + size] for i in range(0, len(rows), size))), ignore_index=True)
        assert got.astype(str).equals(want.astype(str))
    assert list(run(iter([rows[:0]]))) == []


def test_search_is_spread_over_tasks(spark, monkeypatch):
    rows = cells(24)
    frame = spark.createDataFrame(rows.loc[rows.index.repeat(rows["_m"])].drop(columns="_m").assign(split="val"))
    tasks, cut = {}, ensemble.cut_lineage

    def noted(df):
        made = cut(df)
        tasks[tuple(df.columns)] = sum(1 for n in made.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n)
        return made

    monkeypatch.setattr(ensemble, "cut_lineage", noted)
    found = {r.series_id: r for r in ensemble.search_weights(frame, MEMBERS).collect()}
    assert tasks[tuple(ensemble._STATE)] >= 3
    assert len(found) == 24 and all(r.gap <= 2e-3 and abs(sum(r.weights) - 1) < 1e-9 for r in found.values())
