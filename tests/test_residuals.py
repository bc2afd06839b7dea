from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadloom.functions import stats
from loadloom.operators import decompose, profile, residuals


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    noise = rng.normal(0, 3, 600)
    ar = np.zeros(900)
    for t in range(1, 900):
        ar[t] = 0.6 * ar[t - 1] + rng.normal(0, 2)
    walk = np.cumsum(rng.normal(0, 1, 20_000))  # longer than two blocks
    return {"noise": noise, "ar": ar + 10, "walk": walk}


@pytest.fixture(scope="module")
def rows(spark, series):
    df = spark.createDataFrame(pd.concat([
        pd.DataFrame({"series_id": k, "pos": np.arange(len(v)), "resid": v})
        for k, v in series.items()])).cache()
    df.count()
    return df


def by_series(df):
    return {r.series_id: r for r in df.collect()}


def acf(x, k):
    x = x - x.mean()
    return 1.0 if k == 0 else (x[k:] * x[:-k]).sum() / (x * x).sum()


def test_autocorrelation_and_profile(rows, series):
    got = by_series(residuals.autocorrelation(rows, "resid", (1, 24, 700)))
    for k, x in series.items():
        assert got[k].acf_1 == pytest.approx(acf(x, 1), abs=1e-8)
        assert got[k].acf_24 == pytest.approx(acf(x, 24), abs=1e-8)
    assert got["noise"].acf_700 is None
    prof = residuals.acf_profile(rows.where("series_id != 'walk'"), "resid", 30).toPandas()
    for k in ("noise", "ar"):
        mine = prof[prof["series_id"] == k].sort_values("lag")["acf"].to_numpy()
        np.testing.assert_allclose(mine, [acf(series[k], j) for j in range(31)], atol=1e-9)


def test_pacf_solves_yule_walker(rows, series):
    got = residuals.pacf_profile(rows.where("series_id = 'ar'"), "resid", 12).toPandas()
    rho = np.array([acf(series["ar"], j) for j in range(13)])
    for k in (1, 2, 5, 12):
        matrix = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        want = np.linalg.solve(matrix, rho[1:k + 1])[-1]
        assert got[got["lag"] == k]["pacf"].iloc[0] == pytest.approx(want, abs=1e-9)


def adf_direct(y):
    n = len(y)
    top = max(0, min(n // 2 - 2, int(np.ceil(12 * (n / 100) ** 0.25))))
    d = np.diff(y)

    def fit(p, first):
        t = np.arange(first, n)
        x = np.column_stack([y[t - 1], np.ones(len(t)), *[d[t - 1 - k] for k in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(x, d[t - 1], rcond=None)
        res = d[t - 1] - x @ beta
        ssr, m = res @ res, len(t)
        aic = m * (np.log(2 * np.pi) + np.log(ssr / m) + 1) + 2 * x.shape[1]
        cov = ssr / (m - x.shape[1]) * np.linalg.inv(x.T @ x)
        return aic, beta[0] / np.sqrt(cov[0, 0])

    lag = int(np.argmin([fit(p, top + 1)[0] for p in range(top + 1)]))
    return lag, fit(lag, lag + 1)[1]


def test_adf_matches_direct_regression_also_over_blocks(rows, series):
    got = by_series(residuals.adf(rows))
    for k, y in series.items():
        lag, stat = adf_direct(y)
        assert got[k].lags == lag and got[k].nobs == len(y) - 1 - lag
        assert got[k].adf == pytest.approx(stat, abs=1e-5)
    assert got["noise"].adf_p < 1e-6 and got["ar"].adf_p < 0.01 and got["walk"].adf_p > 0.05


def test_adf_p_value_at_a_published_critical_value():
    x = sum(c * (-2.86154) ** i for i, c in enumerate(stats.ADF_SMALL_P))
    assert NormalDist().cdf(x) == pytest.approx(0.05, abs=0.001)


def kpss_direct(x):
    n, r = len(x), x - x.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = (r @ r) / n, 0.0
    for i in range(1, cov + 1):
        g = (r[i:] @ r[:-i]) / (n / 2)
        s0, s1 = s0 + g, s1 + i * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = (r @ r + 2 * sum((r[i:] @ r[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return lags, (np.cumsum(r) ** 2).sum() / n ** 2 / lrv


def test_kpss_matches_lag_sums(rows, series):
    got = by_series(residuals.kpss(rows))
    for k, x in series.items():
        lags, stat = kpss_direct(x)
        assert got[k].lags == lags
        assert got[k].kpss == pytest.approx(stat, rel=1e-6)
        assert got[k].kpss_p == pytest.approx(np.interp(stat, stats.KPSS_CRITICAL, stats.KPSS_P))


def test_ljung_box_and_jarque_bera(rows, series):
    lb = by_series(residuals.ljung_box(rows))
    jb = by_series(residuals.jarque_bera(rows))
    for k, x in series.items():
        n = len(x)
        q = n * (n + 2) * sum(acf(x, j) ** 2 / (n - j) for j in range(1, 11))
        assert lb[k].lb_10 == pytest.approx(q, rel=1e-6)
        z = (x - x.mean()) / x.std()
        want = n / 6 * ((z ** 3).mean() ** 2 + ((z ** 4).mean() - 3) ** 2 / 4)
        assert jb[k].jb == pytest.approx(want, rel=1e-6)
        assert jb[k].jb_p == pytest.approx(np.exp(-want / 2), abs=1e-9)
    assert lb["noise"].lb_p_10 > 0.001 and lb["ar"].lb_p_20 < 1e-6


def test_chi_square_tail(spark):
    # P(X > 18.307) = 0.05 with 10, P(X > 31.410) = 0.05 with 20 degrees of freedom.
    r = spark.range(1).select(stats.chi2_tail_even(F.lit(18.307), 10).alias("a"),
                              stats.chi2_tail_even(F.lit(31.410), 20).alias("b")).first()
    assert r.a == pytest.approx(0.05, abs=1e-5) and r.b == pytest.approx(0.05, abs=1e-5)
    with pytest.raises(ValueError):
        stats.chi2_tail_even(F.lit(1.0), 3)


def test_normal_quantile(spark):
    p = [1e-15, 1e-9, 1e-4, 0.01, 0.07, 0.3, 0.5, 0.75, 0.93, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(
        stats.normal_quantile(F.col("p")).alias("z")).toPandas()["z"]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=1e-9, atol=1e-12)


def test_qq_points(rows, series):
    got = residuals.qq_points(rows.where("series_id = 'noise'")).toPandas().sort_values("rank0")
    np.testing.assert_allclose(got["ordered"], np.sort(series["noise"]))
    n = len(series["noise"])
    first = NormalDist().inv_cdf(1 - 0.5 ** (1 / n))
    assert got["theoretical"].iloc[0] == pytest.approx(first)
    assert got["theoretical"].iloc[-1] == pytest.approx(-first)


def test_near_constant_residuals_give_no_p_values(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({
        "series_id": "flat", "pos": np.arange(300), "resid": 5 + rng.normal(0, 1e-3, 300)}))
    r = residuals.residual_tests(df).first()
    assert r.adf_p is None and r.kpss_p is None and r.durbin_watson is None and r.normality_p is None


def test_diagnostics_advice(rows):
    got = by_series(residuals.residual_diagnostics(rows))
    assert "first-order autocorrelation" in got["walk"].advice
    assert "first-order autocorrelation" not in got["noise"].advice
    assert got["noise"].dw == pytest.approx(2, abs=0.3)


def test_decomposition(spark):
    t = np.arange(24 * 20)
    shape = np.sin(2 * np.pi * t / 24) * 7
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": t, "load": 50 + 0.1 * t + shape}))
    got = decompose.seasonal_decompose(df).toPandas().sort_values("pos")
    assert got["trend"].isna().sum() == 24
    np.testing.assert_allclose(got["trend"][12:-12], 50 + 0.1 * t[12:-12], atol=1e-9)
    np.testing.assert_allclose(got["seasonal"], shape, atol=1e-9)
    with pytest.raises(ValueError):
        decompose.seasonal_decompose(df, period=7)


def test_profiles_match_pandas(spark, grid, hourly):
    a = hourly[hourly["series_id"] == "a"]["load"]
    d = profile.describe(grid).where("series_id = 'a'").first()
    want = a.describe()
    assert d["count"] == want["count"] and d.q25 == pytest.approx(want["25%"])
    assert d.std == pytest.approx(want["std"]) and d.q75 == pytest.approx(want["75%"])
    m = profile.moments(grid).where("series_id = 'a'").first()
    assert m.skew == pytest.approx(a.skew()) and m.kurt == pytest.approx(a.kurtosis())
    counts, edges = np.histogram(a, bins=60)
    h = profile.histogram(grid).where("series_id = 'a'").toPandas().set_index("bin")
    assert [int(h["count"].get(i, 0)) for i in range(60)] == list(counts)
    b = profile.value_bins(grid, "temperature").where("series_id = 'a'").toPandas()
    part = hourly[hourly["series_id"] == "a"]
    cut = part.groupby(pd.cut(part["temperature"], bins=36), observed=True)["load"]
    b = b.sort_values("bin")
    np.testing.assert_allclose(b["median"], cut.median())
    np.testing.assert_allclose(b["p10"], cut.quantile(0.1))
    cells = profile.density_2d(grid, "temperature").where("series_id = 'a'").toPandas()
    assert cells["count"].sum() == len(part) and (cells["count"] >= 1).all()


def test_lag_products_keep_their_lags_around_nulls(spark):
    x = np.random.default_rng(4).normal(5, 2, 60)
    rows = [("s", i, None if i == 20 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, pos long, load double")
    got = {r.lag: r for r in residuals.lag_products(df, "load", 3).collect()}
    x[20] = np.nan
    mean = np.nanmean(x)
    for lag in range(4):
        a, b = x[lag:] - mean, x[:len(x) - lag] - mean
        assert got[lag].n == 59 and got[lag].c == pytest.approx(np.nansum(a * b))


def test_lag_products_over_short_blocks_equal_direct_sums(spark):
    rng = np.random.default_rng(8)
    x = 1e9 + rng.normal(size=700)  # the mean is 10^9 times the spread
    gone = rng.random(700) < 0.1
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": np.arange(700), "load": x, "gone": gone})).withColumn(
        "load", F.when(~F.col("gone"), F.col("load")))
    got = residuals.lag_products(df, "load", 40, block_rows=100).toPandas().sort_values("lag")
    z = np.where(gone, 0.0, x - x[~gone].mean())
    want = [(z[k:] * z[:700 - k]).sum() for k in range(41)]
    np.testing.assert_allclose(got["c"], want, atol=1e-4)
    assert set(got["n"]) == {int((~gone).sum())}


def test_lag_sums_of_a_short_series_end_with_its_pairs(spark):
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": np.arange(3), "resid": [1.0, 2.0, 4.0]}))
    assert sorted(r.lag for r in residuals.lag_products(df, "resid", 10).collect()) == [0, 1, 2]
    r = residuals.ljung_box(df).first()
    assert r.n == 3 and r.lb_10 is None and r.lb_p_20 is None


def test_autocorrelation_keeps_its_digits_beside_a_large_mean(spark):
    x = np.random.default_rng(9).normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "pos": np.arange(400), "resid": 1e8 + x}))
    got = residuals.autocorrelation(df, "resid", (1, 24)).first()
    assert got.acf_1 == pytest.approx(acf(x, 1), abs=1e-6) and got.acf_24 == pytest.approx(acf(x, 24), abs=1e-6)
