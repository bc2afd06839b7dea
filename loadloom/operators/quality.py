"""Data-quality checks and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ForecastConfig
from ..functions.timeparts import hour_index
from .residuals import autocorrelation
from .windows import is_origin


def is_bad(x: Column) -> Column:
    """NULL, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def row_contract(df: DataFrame, days: int | None = None) -> DataFrame:
    """Rows per series against ``days * 24`` (or the series' own span)."""
    expected = F.lit(days * 24) if days is not None else F.max("n")
    return (
        df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                    expected.cast("bigint").alias("expected"))
        .withColumn("complete", F.col("n_rows") == F.col("expected"))
    )


def hour_contract(raw: DataFrame, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Hours observed in the raw rows per series, against the hours of its own span.

    ``n_rows`` counts the rows with a time, ``n_dropped`` those without, which no grid holds. Rows
    without a series share one group whose ``series_id`` is NULL. Rows are combined per hour before
    the counts, so a series of any volume is a row per hour and task.
    """
    hours = raw.groupBy(F.col(series).cast("string").alias("series_id"),
                        hour_index(F.col(ts)).alias("hr")).agg(F.count(F.lit(1)).alias("rows"))
    timed = F.col("hr").isNotNull()
    rows = lambda when: F.coalesce(F.sum(F.when(when, F.col("rows"))), F.lit(0))
    return hours.groupBy("series_id").agg(
        F.count("hr").alias("n_hours"), (F.max("hr") - F.min("hr") + 1).alias("expected"),
        rows(timed).alias("n_rows"), rows(~timed).alias("n_dropped"),
    ).withColumn("complete", F.col("series_id").isNotNull() & F.coalesce(
        F.col("n_hours") == F.col("expected"), F.lit(False)) & (F.col("n_dropped") == 0))


def quality_facts(df: DataFrame, value: str = "load") -> DataFrame:
    """One row per series with every figure of the report.

    Reduced by (series, hour of day) first: 24 rows per series reach the second step.
    Needs ts, pos and n next to the value; weather and device columns are optional.
    """
    x = F.col(value)
    t = F.col("ts")
    season = F.month(t)
    optional = {
        "temperature": lambda c: [F.min(c).alias("t_lo"), F.max(c).alias("t_hi")],
        "ev_load_norm": lambda c: [F.sum(c).alias("ev_sum")],
        "solar_gen_norm": lambda c: [F.sum(c).alias("solar_sum")],
        "dsr_active": lambda c: [F.sum(c).alias("dsr_sum")],
    }
    extra = [a for c, make in optional.items() if c in df.columns for a in make(F.col(c))]

    def part(name: str, keep: Column) -> list[Column]:
        return [F.sum(F.when(keep, x)).alias(f"{name}_sum"),
                F.count_if(keep & x.isNotNull()).alias(f"{name}_cnt")]

    hourly = df.groupBy("series_id", F.hour(t).alias("hour")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("cnt"), F.sum(x).alias("total"),
        F.sum(x * x).alias("squares"),
        F.count_if(is_bad(x)).alias("bad"), F.count_if(x < 0).alias("negative"),
        *part("we", F.weekday(t) >= 5), *part("wd", F.weekday(t) < 5),
        *part("winter", season.isin(12, 1, 2)), *part("summer", season.between(6, 8)), *extra)
    mean = F.col("total") / F.col("cnt")

    def top_hour(low: int, high: int) -> Column:
        # Largest mean; the earlier hour on a tie.
        best = F.max(F.when(F.col("hour").between(low, high), F.struct(mean, -F.col("hour"))))
        return -best["col2"]

    def ratio(name: str) -> Column:
        return F.sum(f"{name}_sum") / F.sum(f"{name}_cnt")

    n, total = F.sum("cnt"), F.sum("total")
    variance = (F.sum("squares") - total * total / n) / (n - 1)
    facts = {
        "n_rows": F.sum("rows"), "nan_inf": F.sum("bad"), "negative": F.sum("negative"),
        "morning_peak": top_hour(6, 11), "evening_peak": top_hour(17, 22),
        "weekend_ratio": ratio("we") / ratio("wd"),
        "winter_mean": ratio("winter"), "summer_mean": ratio("summer"),
        "cv": F.sqrt(F.greatest(variance, F.lit(0.0))) / (total / n),
    }
    if "temperature" in df.columns:
        facts |= {"temp_min": F.min("t_lo"), "temp_max": F.max("t_hi")}
    for c, name in (("ev_load_norm", "ev"), ("solar_gen_norm", "solar")):
        if c in df.columns:
            facts[f"{name}_mean"] = F.sum(f"{name}_sum") / F.sum("rows")
    if "dsr_active" in df.columns:
        facts["dsr_hours"] = F.sum("dsr_sum")
    profile = hourly.groupBy("series_id").agg(*[c.alias(k) for k, c in facts.items()])
    acf = autocorrelation(df, value, (24, 168), denominator="n-lag", eps=1e-10)
    return profile.join(acf.drop("n"), "series_id")


def quality_report(df: DataFrame, value: str = "load") -> DataFrame:
    """(series_id, check, value, status). Only bad and negative values can fail."""
    facts = quality_facts(df, value)
    ok = F.lit("pass")

    def gate(test: Column, other: str) -> Column:
        return F.when(test, ok).otherwise(other)

    rules = {
        "nan_inf": gate(F.col("nan_inf") == 0, "fail"),
        "negative": gate(F.col("negative") == 0, "fail"),
        "morning_peak": gate(F.col("morning_peak").between(6, 11), "warn"),
        "evening_peak": gate(F.col("evening_peak").between(17, 22), "warn"),
        "weekend_ratio": F.lit("info"),
        "winter_over_summer": F.when(F.col("winter_over_summer").isNull(), "info")
        .otherwise(gate(F.col("winter_over_summer") > 0, "warn")),
        "acf_24": gate(F.coalesce("acf_24", F.lit(0.0)) >= 0.35, "warn"),
        "acf_168": F.when(F.col("n_rows") < 336, "info")
        .otherwise(gate(F.coalesce("acf_168", F.lit(0.0)) >= 0.15, "warn")),
        "cv": F.lit("info"),
    }
    for c in ("temp_min", "temp_max", "ev_mean", "solar_mean", "dsr_hours"):
        if c in facts.columns:
            rules[c] = F.lit("info")
    facts = facts.withColumn("winter_over_summer", F.col("winter_mean") - F.col("summer_mean"))
    entries = [F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"),
                        s.alias("status")) for c, s in rules.items()]
    return facts.select("series_id", F.inline(F.array(*entries)))


def drift_check(df: DataFrame, value: str = "load", limit: float = 1.15) -> DataFrame:
    """Mean of test against mean of train; ``drift`` when above the limit."""
    def mean(split: str) -> Column:
        return F.avg(F.when(F.col("split") == split, F.col(value)))

    return (
        df.groupBy("series_id").agg(mean("train").alias("mean_train"),
                                    mean("test").alias("mean_test"))
        .withColumn("drift", F.col("mean_test") > limit * F.col("mean_train"))
    )


def alignment_report(truth: DataFrame, pred: DataFrame,
                     keys: Sequence[str] = ("series_id", "origin_idx", "h")) -> DataFrame:
    """Matched and unmatched keys of the two tables; one row."""
    a = truth.select(*keys).withColumn("_t", F.lit(1))
    b = pred.select(*keys).withColumn("_p", F.lit(1))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("matched"),
        F.count_if(F.col("_p").isNull()).alias("only_truth"),
        F.count_if(F.col("_t").isNull()).alias("only_pred"))


def require_aligned(truth: DataFrame, pred: DataFrame,
                    keys: Sequence[str] = ("series_id", "origin_idx", "h")) -> None:
    """ValueError when the tables are empty or their keys differ."""
    row = alignment_report(truth, pred, keys).first()
    if row["only_truth"] or row["only_pred"]:
        raise ValueError(f"truth and prediction differ in length or keys: {row.asDict()}")
    if not row["matched"]:
        raise ValueError("truth and prediction are empty")


def window_integrity(features: DataFrame, cfg: ForecastConfig, channels: Sequence[str],
                     target: str = "consumption") -> DataFrame:
    """Per series and split: origins, bad values, largest target, and a verdict.

    A value is in some window exactly when its row is, so rows are checked instead of
    the L-fold copies.
    """
    bad = sum((F.count_if(is_bad(F.col(c))) for c in channels), F.lit(0))
    seen_as_target = F.col("split_pos") >= cfg.history
    top = F.max(F.when(seen_as_target, F.col(target)))
    per = features.groupBy("series_id", "split").agg(
        F.count_if(is_origin(cfg)).alias("n_windows"), bad.alias("n_bad"), top.alias("y_max"))
    strict = not cfg.seasonal_diff
    verdict = (
        F.when(F.col("n_bad") > 0, "fail").when(F.col("n_windows") == 0, "fail")
        .when(F.lit(strict) & (F.col("y_max") > 1.50), "fail")
        .when(F.lit(strict) & (F.col("y_max") > 1.05), "warn").otherwise("pass"))
    return per.withColumn("status", verdict)
