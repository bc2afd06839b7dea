import pathlib
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from loadloom.session import local_session  # noqa: E402
from loadloom.sources.grid import with_split  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", memory="4g", app="tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s


def hourly_pandas(days: int, series=("a", "b"), start="2024-01-01", seed=7) -> pd.DataFrame:
    """Complete hourly rows with a daily shape and noise."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, name in enumerate(series):
        ts = pd.date_range(start, periods=24 * days, freq="h")
        load = (100 + 20 * i + 30 * np.sin(2 * np.pi * ts.hour / 24)
                + 10 * (ts.dayofweek >= 5) + rng.normal(0, 5, len(ts)))
        parts.append(pd.DataFrame({
            "series_id": name, "ts": ts, "pos": np.arange(len(ts)), "n": len(ts),
            "load": load, "temperature": 15 + 10 * np.cos(2 * np.pi * ts.hour / 24)
            + rng.normal(0, 2, len(ts))}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    """DataFrame with naive timestamps."""
    df = spark.createDataFrame(pdf)
    return df.withColumn("ts", df["ts"].cast("timestamp_ntz")) if "ts" in pdf else df


@pytest.fixture(scope="session")
def hourly(spark):
    return hourly_pandas(30)


@pytest.fixture(scope="session")
def grid(spark, hourly):
    df = with_split(to_spark(spark, hourly)).cache()
    df.count()
    return df
