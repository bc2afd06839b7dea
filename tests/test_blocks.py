import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from loadloom.operators.blocks import BINS, Blocks, exact_quantiles, running_sum, value_rank, value_tallies


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.concat([
        pd.DataFrame({"series_id": "hot", "pos": np.arange(500), "v": rng.normal(size=500)}),
        pd.DataFrame({"series_id": "short", "pos": np.arange(7), "v": rng.normal(size=7)})])
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("before,after,size", [(23, 0, 40), (5, 9, 16), (60, 10, 20), (0, 0, 33)])
def test_block_frames_equal_whole_series_frames(rows, before, after, size):
    blocks = Blocks(before=before, after=after, rows=size)
    got = blocks.core(blocks.spread(rows).withColumn(
        "s", F.sum("v").over(blocks.frame(-before, after))))
    whole = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-before, after)
    want = rows.withColumn("w", F.sum("v").over(whole))
    both = got.join(want, ["series_id", "pos"]).toPandas()
    assert len(both) == 507
    np.testing.assert_allclose(both["s"], both["w"], atol=1e-12)


def test_frame_beyond_the_halo_is_refused():
    with pytest.raises(ValueError):
        Blocks(before=3).frame(-4, 0)


def test_running_sum_over_blocks(rows):
    got = running_sum(rows, "v", "c", rows=32).toPandas().sort_values(["series_id", "pos"])
    want = got.groupby("series_id")["v"].cumsum()
    np.testing.assert_allclose(got["c"], want, atol=1e-12)


def test_value_rank_numbers_every_row(rows):
    got = value_rank(rows, "v").toPandas()
    for _, part in got.groupby("series_id"):
        part = part.sort_values("v")
        assert list(part["rank0"]) == list(range(len(part)))
        assert set(part["n"]) == {len(part)}


def test_value_rank_with_a_dominant_value(spark):
    df = spark.range(20_000).select(F.lit("s").alias("series_id"), F.when(
        F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v"))
    got = value_rank(df, "v").toPandas().sort_values("rank0")
    assert list(got["rank0"]) == list(range(20_000))
    assert got["v"].is_monotonic_increasing and (got["v"] == 0).sum() == 13_333 + 1


def test_exact_quantiles_match_numpy_with_heavy_ties(spark):
    rng = np.random.default_rng(3)
    values = {"zeros": np.r_[np.zeros(400), rng.exponential(50, 100)],
              "signed": rng.normal(0, 1000, 333), "one": np.array([4.5]),
              "close": 1000 + rng.random(257)}
    pdf = pd.concat([pd.DataFrame({"series_id": k, "v": v}) for k, v in values.items()])
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.753, "e": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), "v", probs).toPandas().set_index("series_id")
    for k, v in values.items():
        for name, p in probs.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(v, p), abs=1e-9)


@pytest.mark.parametrize("shape", ["narrow", "outlier", "tails", "ties"])
def test_no_bin_holds_much_more_than_its_share(spark, shape):
    rng = np.random.default_rng(4)
    x = {"narrow": rng.normal(57_000, 50, 40_000),
         "outlier": np.r_[rng.normal(57_000, 50, 40_000), 1e15, -1e15],
         "tails": rng.standard_cauchy(40_000),
         "ties": np.r_[np.zeros(60_000), rng.exponential(1, 40_000)]}[shape]
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "v": x}))
    bins = value_tallies(df, "v", ["series_id"]).groupBy("_bin").agg(
        F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).toPandas().sort_values("_bin")
    assert bins["n"].sum() == len(set(x)) and bins["_bin"].between(0, BINS - 1).all()
    assert bins["n"].max() <= 2 * len(set(x)) / BINS
    assert (bins["lo"].to_numpy()[1:] > bins["hi"].to_numpy()[:-1]).all()
    got = exact_quantiles(df, "v", {"q": 0.37}).first()
    assert got.q == pytest.approx(np.quantile(x, 0.37), rel=1e-12)
