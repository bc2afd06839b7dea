"""Autocorrelation, residual diagnostics and residual tests.

``pos`` must number the rows of each key without gaps. For residuals of overlapping
windows use ``origin_idx`` after fixing h (order in time), or
``origin_idx * horizon + h - 1`` (flat order, the way a flattened matrix is read).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import stats
from .blocks import BLOCK, BLOCK_ROWS, Blocks, running_sum, value_rank

SERIES = ("series_id",)


def flat_position(horizon: int) -> Column:
    """Row number in a flattened (origin, h) matrix."""
    return F.col("origin_idx") * horizon + F.col("h") - 1


def _lag_sums(df: DataFrame, value: str, lags: Sequence[int], keys: Sequence[str], pos: str
              ) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with one lag column per k, and the three aggregates each lag needs.

    They are central moments of the pairs, so a large mean costs no digits.
    """
    blocks = Blocks(keys=keys, pos=pos, before=max(lags))
    ordered = blocks.window()
    rows = blocks.core(blocks.spread(df.select(*keys, pos, value)).withColumns(
        {f"_l{k}": F.lag(value, k).over(ordered) for k in lags}))
    x, sums = F.col(value), {}
    for k in lags:
        back = F.col(f"_l{k}")
        sums[f"_cov{k}"] = F.covar_pop(x, back)
        sums[f"_mx{k}"] = F.avg(F.when(back.isNotNull(), x))
        sums[f"_my{k}"] = F.avg(F.when(x.isNotNull(), back))
    return rows, sums


def _covariance_sum(k: int, n: Column, mean: Column) -> Column:
    """Σ (x_t − m)(x_{t−k} − m) from the moments of lag k."""
    return (n - k) * (F.col(f"_cov{k}") + (F.col(f"_mx{k}") - mean) * (F.col(f"_my{k}") - mean))


def autocorrelation(df: DataFrame, value: str, lags: Sequence[int],
                    keys: Sequence[str] = SERIES, pos: str = "pos", denominator: str = "n",
                    eps: float = 1e-12) -> DataFrame:
    """acf_{k} per key for a few lags, in one pass; NULL where a series is no longer than k.

    ``denominator="n"`` divides the products by n, ``"n-lag"`` by their number.
    """
    rows, sums = _lag_sums(df, value, lags, keys, pos)
    per = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"),
        *[c.alias(name) for name, c in sums.items()])
    n, mean = F.col("n"), F.col("_m")
    out = []
    for k in lags:
        count = n - k if denominator == "n-lag" else n
        acf = _covariance_sum(k, n, mean) / (count * (F.col("_v") + eps))
        out.append(F.when(n > k, acf).alias(f"acf_{k}"))
    return per.select(*keys, "n", *out)


def _block_products(x: np.ndarray, ok: np.ndarray, first: int, max_lag: int) -> tuple[np.ndarray, ...]:
    """(pairs, Σ x_t + x_{t−k}, Σ x_t x_{t−k}) at the lags 0..max_lag over the rows t from ``first`` on.

    One zero-padded Fourier transform of each column gives all lags; the flags ``ok`` go the same
    way, so rows without a value take no part and the others keep their distance.
    """
    size = 1 << int(len(x) + max_lag - 1).bit_length()
    x, flag = np.where(ok, x, 0.0), ok.astype(float)
    home = np.arange(len(x)) >= first
    fx, ff = np.fft.rfft(x * home, size), np.fft.rfft(flag * home, size)
    bx, bf = np.fft.rfft(x, size).conj(), np.fft.rfft(flag, size).conj()
    pairs, sums, products = np.fft.irfft(np.stack([ff * bf, fx * bf + ff * bx, fx * bx]), size)[:, :max_lag + 1]
    pairs = np.rint(pairs).astype(np.int64)
    return pairs, np.where(pairs, sums, 0.0), np.where(pairs, products, 0.0)


def lag_products(df: DataFrame, value: str, max_lag: int, keys: Sequence[str] = SERIES,
                 pos: str = "pos", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, lag, n, mean, c): Σ of demeaned products for every lag 0..max_lag, as far as there are pairs.

    A block with its ``max_lag`` rows before it gives the sums of all lags by Fourier transforms and sends
    max_lag + 1 rows to the shuffle. The key's mean is taken off first, so a large mean costs no digits. NULL values
    keep their place, so the lags stay right; such pairs do not count.
    """
    keys = list(keys)
    blocks = Blocks(keys=keys, pos=pos, before=max_lag, rows=block_rows)
    size = blocks.rows
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    rows = blocks.spread(df.join(means, keys).select(
        *keys, pos, "_mean", (F.col(value) - F.col("_mean")).alias("_x"), F.col(value).isNotNull().alias("_ok")))

    def block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf[BLOCK].iloc[0]) * size
        at = pdf[pos].to_numpy() - (start - max_lag)
        x, ok = np.zeros(at.max() + 1), np.zeros(at.max() + 1, bool)
        x[at], ok[at] = pdf["_x"].to_numpy(float), pdf["_ok"].to_numpy(bool)
        pairs, sums, products = _block_products(x, ok, max_lag, max_lag)
        out = pd.DataFrame({"lag": np.arange(max_lag + 1, dtype=np.int32), "_pairs": pairs, "_xs": sums, "_xy": products,
                            "_mean": pdf["_mean"].iloc[0]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[out["_pairs"] > 0]

    schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("lag", T.IntegerType()), T.StructField("_pairs", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("_xs", "_xy", "_mean")]])
    # The rows compress well, so adaptive execution would merge more of them into a task than it has to sort at once.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *keys, BLOCK)
    sums = rows.groupBy(*keys, BLOCK).applyInPandas(block_sums, schema).groupBy(*keys, "lag").agg(
        *[F.sum(c).alias(c) for c in ("_pairs", "_xs", "_xy")], F.max("_mean").alias("_mean"))
    per_key = Window.partitionBy(*keys)  # max_lag + 1 rows
    off = F.max(F.when(F.col("lag") == 0, F.col("_xs") / (2.0 * F.col("_pairs")))).over(per_key)
    return sums.select(
        *keys, "lag", F.max("_pairs").over(per_key).alias("n"), (F.col("_mean") + off).alias("mean"),
        (F.col("_xy") - off * F.col("_xs") + F.col("_pairs") * off * off).alias("c"))


def acf_profile(df: DataFrame, value: str, max_lag: int = 200, keys: Sequence[str] = SERIES,
                pos: str = "pos") -> DataFrame:
    """Autocorrelation at every lag 0..max_lag, as (keys, lag, acf)."""
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(Window.partitionBy(*keys))
    return lag_products(df, value, max_lag, keys, pos).select(
        *keys, "lag", F.when(zero != 0, F.col("c") / zero).alias("acf"))


def _levinson(rho: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations (Durbin's recursion)."""
    out = np.full(len(rho), np.nan)
    out[0] = 1.0
    phi = np.zeros(0)
    for k in range(1, len(rho)):
        scale = 1.0 - phi @ rho[1:k]
        if scale == 0:
            break
        last = (rho[k] - phi @ rho[k - 1:0:-1]) / scale
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def pacf_profile(df: DataFrame, value: str, max_lag: int = 50, keys: Sequence[str] = SERIES,
                 pos: str = "pos") -> DataFrame:
    """Partial autocorrelation at lags 0..max_lag; the recursion sees max_lag + 1 numbers."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def partial(rho: pd.Series) -> pd.Series:
        return rho.map(lambda r: _levinson(np.asarray(r, dtype=float)))

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"])
    per = acf_profile(df, value, max_lag, keys, pos).groupBy(*keys).agg(ordered.alias("_rho"))
    return per.select(*keys, F.posexplode(partial("_rho")).alias("lag", "pacf"))


def residual_diagnostics(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES,
                         pos: str = "pos") -> DataFrame:
    """n, DW, ACF at 1/24/48/168, skewness, plain (not excess) kurtosis, and advice."""
    lags = (1, 24, 48, 168)
    rows, sums = _lag_sums(df, resid, lags, keys, pos)
    r = F.col(resid)
    step = r - F.col("_l1")
    per = rows.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("_m"), F.var_pop(r).alias("_v"),
        (F.sum(step * step) / (F.sum(r * r) + 1e-12)).alias("dw"),
        F.skewness(r).alias("skewness"), (F.kurtosis(r) + 3.0).alias("kurtosis"),
        *[c.alias(name) for name, c in sums.items()])
    n = F.col("n")
    acfs = [F.when(n > k, _covariance_sum(k, n, F.col("_m")) / (n * (F.col("_v") + 1e-12)))
            .alias(f"acf_{k}") for k in lags]
    out = per.select(*keys, "n", "dw", *acfs, "skewness", "kurtosis")
    advice = F.array_compact(F.array(
        F.when(F.col("dw") < 1.5, "first-order autocorrelation"),
        F.when(F.abs("acf_24") > 0.10, "daily component left"),
        F.when(F.abs("acf_168") > 0.10, "weekly component left"),
        F.when(F.col("kurtosis") > 5, "heavy tails: use a Huber loss")
        .when(F.col("kurtosis") > 3, "Huber loss in use")))
    return out.withColumn("advice", F.concat_ws("; ", advice))


def residual_summary(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES,
                     min_std: float = 1.0) -> DataFrame:
    """mean, std (population), min, max, and whether the tests make sense."""
    r = F.col(resid)
    return df.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"),
        F.min(r).alias("min"), F.max(r).alias("max"),
    ).withColumn("testable", F.col("std") >= min_std)


def ljung_box(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES,
              pos: str = "pos", at: Sequence[int] = (10, 20)) -> DataFrame:
    """Q statistic and p-value at each (even) number of lags."""
    per_key = Window.partitionBy(*keys)
    n, zero = F.col("n"), F.max(F.when(F.col("lag") == 0, F.col("c"))).over(per_key)
    terms = lag_products(df, resid, max(at), keys, pos).select(
        *keys, "n", "lag", F.when(zero != 0, F.col("c") / zero).alias("_r")).where(n > F.col("lag"))
    part = F.col("_r") * F.col("_r") / (n - F.col("lag"))
    q = terms.groupBy(*keys, "n").agg(*[
        F.sum(F.when(F.col("lag").between(1, m), part)).alias(f"_q{m}") for m in at])
    # The p-value mentions the statistic many times, so it refers to a finished column.
    return q.select(*keys, "n", *[F.when(n > m, n * (n + 2) * F.col(f"_q{m}")).alias(f"lb_{m}") for m in at]).withColumns(
        {f"lb_p_{m}": stats.chi2_tail_even(F.col(f"lb_{m}"), m) for m in at})


def jarque_bera(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES) -> DataFrame:
    """Normality from population skewness and excess kurtosis."""
    r = F.col(resid)
    per = df.groupBy(*keys).agg(F.count(r).alias("n"), F.skewness(r).alias("_s"),
                                F.kurtosis(r).alias("_k"))
    jb = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    return per.select(*keys, "n", jb.alias("jb"), F.exp(-jb / 2.0).alias("jb_p"))


def _longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the longest key; one aggregate, run while the plan is built."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1


def kpss(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES,
         pos: str = "pos") -> DataFrame:
    """Level-stationarity test with the automatic bandwidth.

    The long-run variance with Bartlett weights over M-1 lags equals the mean square of
    the demeaned series' moving sums of length M, divided by M. Moving sums are
    differences of the running sum, which the statistic needs anyway, so one equi-join
    replaces a pass per lag whatever the bandwidth. The lags of the bandwidth's own estimate
    reach as far as the longest key needs.
    """
    keys = list(keys)
    sums = lag_products(df, resid, int(_longest(df, keys) ** (2.0 / 9.0)) + 1, keys, pos)
    n = F.col("n")
    cov = F.floor(F.pow(n.cast("double"), F.lit(2.0 / 9.0)))
    use = F.col("lag").between(1, cov)
    per = sums.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("_mean"),
        (F.sum(F.when(F.col("lag") == 0, F.col("c")).when(use, 2.0 * F.col("c"))))
        .alias("_s0"),
        F.coalesce(F.sum(F.when(use, 2.0 * F.col("lag") * F.col("c"))), F.lit(0.0)).alias("_s1"))
    ratio = F.col("_s1") / F.col("_s0")
    wide = F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(
        n.cast("double"), F.lit(1.0 / 3.0))
    per = per.select(*keys, "n", "_mean", F.least(F.floor(wide), n - 1).alias("lags"))
    path = (
        running_sum(df.select(*keys, pos, resid), resid, "_cum", keys, pos)
        .join(per, keys)
        .select(*keys, pos, "n", "lags",
                (F.col("_cum") - (F.col(pos) + 1) * F.col("_mean")).alias("_s"))
    )
    width = F.col("lags") + 1
    behind = path.select(*keys, (F.col(pos) + width).alias(pos), F.col("_s").alias("_back"))
    moving = F.col("_s") - F.coalesce("_back", F.lit(0.0))
    tail = F.when(F.col(pos) >= n - width, F.col("_s") * F.col("_s")).otherwise(0.0)
    out = path.join(behind, [*keys, pos], "left").groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("lags").alias("lags"),
        F.sum(F.col("_s") * F.col("_s")).alias("_eta"),
        F.sum(moving * moving + tail).alias("_lrv"))
    size = n.cast("double")
    stat = (F.col("_eta") / (size * size)) / (F.col("_lrv") / (size * width))
    return out.select(*keys, "n", "lags", stat.alias("kpss")).withColumn(
        "kpss_p", stats.kpss_p(F.col("kpss")))


def _adf_max_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, int(np.ceil(12.0 * (n / 100.0) ** 0.25))))


def _adf_design(y: np.ndarray, p: int) -> np.ndarray:
    """Columns [Δy_t | y_{t−1}, 1, Δy_{t−1} … Δy_{t−p}] for t = p+1 … len(y)−1."""
    d = np.diff(y)
    rows = len(y) - 1 - p
    lagged = [d[p - k:p - k + rows] for k in range(1, p + 1)]
    return np.column_stack([d[p:], y[p:-1], np.ones(rows), *lagged])


def _adf_fit(gram: np.ndarray, p: int, nobs: int) -> tuple[float, float]:
    """(AIC, t statistic of y_{t−1}) from the cross-product matrix."""
    k = p + 2
    xx, xy = gram[1:k + 1, 1:k + 1], gram[1:k + 1, 0]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    ssr = max(float(gram[0, 0] - beta @ xy), 1e-300)
    aic = nobs * (np.log(2 * np.pi) + np.log(ssr / nobs) + 1.0) + 2.0 * k
    sigma2 = ssr / max(nobs - k, 1)
    return aic, float(beta[0] / np.sqrt(sigma2 * inverse[0, 0]))


def adf(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES,
        pos: str = "pos") -> DataFrame:
    """Augmented Dickey–Fuller test with a constant, lag count by AIC.

    Blocks of a series reduce to a cross-product matrix each; the matrices are added up
    and the regressions solved from the sum, at most a few thousand numbers per key.
    """
    keys = list(keys)
    key_types = [df.schema[k] for k in keys]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Every block gets as many rows before it as the longest key's lags need.
    blocks = Blocks(keys=keys, pos="pos", before=_adf_max_lag(_longest(df, keys)) + 1)
    rows = blocks.spread(
        df.select(*keys, F.col(pos).alias("pos"), F.col(resid).cast("double").alias("_y"))
    ).join(sizes, keys)
    block_rows = blocks.rows

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n, block = int(pdf["_n"].iloc[0]), int(pdf[BLOCK].iloc[0])
        p = _adf_max_lag(n)
        y, at = pdf["_y"].to_numpy(), pdf["pos"].to_numpy()
        parts = []
        first = max(block * block_rows, p + 1)
        keep = at >= first - p - 1
        if keep.sum() > p + 1 and (at >= first).any():
            design = _adf_design(y[keep], p)
            gram = design.T @ design
            i, j = np.indices(gram.shape)
            parts.append(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": gram.ravel()}))
        if block == 0:  # the first values, for the refit with fewer lags
            start = at <= p
            parts.append(pd.DataFrame({"i": -1, "j": at[start], "v": y[start]}))
        out = (pd.concat(parts) if parts
               else pd.DataFrame({"i": [], "j": [], "v": []}))
        out["_n"] = n
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_n", "i", "j", "v"]]

    partial_schema = T.StructType([*key_types, T.StructField("_n", T.LongType()),
                                   T.StructField("i", T.IntegerType()),
                                   T.StructField("j", T.IntegerType()),
                                   T.StructField("v", T.DoubleType())])
    grams = (rows.groupBy(*keys, BLOCK).applyInPandas(reduce_block, partial_schema)
             .groupBy(*keys, "_n", "i", "j").agg(F.sum("v").alias("v")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].iloc[0])
        p = _adf_max_lag(n)
        lag, stat, nobs = None, float("nan"), 0
        cells, head = pdf[pdf["i"] >= 0], pdf[pdf["i"] < 0].sort_values("j")["v"].to_numpy()
        if len(cells):
            gram = np.zeros((p + 3, p + 3))
            gram[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
            scores = [_adf_fit(gram, q, n - 1 - p)[0] for q in range(p + 1)]
            lag = int(np.argmin(scores))
            gram = gram[:lag + 3, :lag + 3]
            if lag < p:  # rows lag+1 … p count too with fewer lags
                extra = _adf_design(head, lag)
                gram = gram + extra.T @ extra
            nobs = n - 1 - lag
            stat = _adf_fit(gram, lag, nobs)[1]
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([row | {"n": n, "lags": lag, "nobs": nobs, "adf": stat}])

    solved_schema = T.StructType([*key_types, T.StructField("n", T.LongType()),
                                  T.StructField("lags", T.IntegerType()),
                                  T.StructField("nobs", T.LongType()),
                                  T.StructField("adf", T.DoubleType())])
    tau = F.when(~F.isnan("adf"), F.col("adf"))
    small, large = stats.horner(tau, stats.ADF_SMALL_P), stats.horner(tau, stats.ADF_LARGE_P)
    index = F.when(tau <= stats.ADF_TAU_STAR, small).otherwise(large)
    p_value = (F.when(tau > stats.ADF_TAU_MAX, F.lit(1.0))
               .when(tau < stats.ADF_TAU_MIN, F.lit(0.0)).otherwise(normal_cdf(index)))
    return (grams.groupBy(*keys).applyInPandas(solve, solved_schema)
            .withColumn("adf", tau).withColumn("adf_p", F.when(tau.isNotNull(), p_value)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    from math import erfc, sqrt

    @F.pandas_udf(T.DoubleType())
    def phi(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: 0.5 * erfc(-v / sqrt(2.0)), na_action="ignore")

    return phi(x)


def qq_points(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES) -> DataFrame:
    """Ordered residuals against normal quantiles at Filliben's plotting positions."""
    ranked = value_rank(df.select(*keys, resid), resid, keys)
    n, i = F.col("n").cast("double"), F.col("rank0") + 1
    edge = F.pow(F.lit(0.5), 1.0 / n)
    share = (F.when(i == F.col("n"), edge).when(i == 1, 1.0 - edge)
             .otherwise((i - 0.3175) / (n + 0.365)))
    return ranked.select(*keys, "rank0", share.alias("_p"), F.col(resid).alias("ordered")).select(
        *keys, "rank0", stats.normal_quantile(F.col("_p")).alias("theoretical"), "ordered")


def residual_tests(df: DataFrame, resid: str = "resid", keys: Sequence[str] = SERIES,
                   pos: str = "pos", min_std: float = 1.0) -> DataFrame:
    """p-values of all tests per key; NULL where the residuals hardly vary."""
    keys = list(keys)
    base = residual_summary(df, resid, keys, min_std).select(*keys, "std", "testable")
    parts = [
        adf(df, resid, keys, pos).select(*keys, "adf_p"),
        kpss(df, resid, keys, pos).select(*keys, "kpss_p"),
        ljung_box(df, resid, keys, pos).select(*keys, "lb_p_10", "lb_p_20"),
        residual_diagnostics(df, resid, keys, pos).select(*keys, F.col("dw").alias("durbin_watson")),
        jarque_bera(df, resid, keys).select(*keys, F.col("jb_p").alias("normality_p")),
    ]
    out = base
    for part in parts:
        out = out.join(part, keys, "left")
    names = ("adf_p", "kpss_p", "lb_p_10", "lb_p_20", "durbin_watson", "normality_p")
    return out.select(*keys, "std",
                      *[F.when(F.col("testable"), F.col(c)).alias(c) for c in names])
