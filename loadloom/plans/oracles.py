"""DuckDB SQL for the registered queries, written from the definitions.

The statements take other routes than the Spark code where one exists: row numbers and
whole-series windows instead of positions and blocks, explicit lag sums instead of
moving sums, recursive queries instead of chunked scans.
"""

from __future__ import annotations

import math

from ..config import COVARIATES, HOLIDAYS, STRATEGIES
from ..functions import stats

PI = repr(math.pi)
ORACLES: dict[str, str] = {}


def r(x: str) -> str:
    """Rounding used for comparison, as in ``tidy``."""
    tiers = " ".join(f"WHEN abs({x}) < {top} THEN round({x} + {nudge!r}::DOUBLE, {digits})"
                     for top, digits, nudge in stats.TIDY_TIERS)
    top, digits, nudge = stats.TIDY_LAST
    return f"(CASE {tiers} ELSE round({x} + {nudge!r}::DOUBLE, {digits}) END + 0.0)"


def rr(*names: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{r(c)} AS {c}" for c in names)


def grid(series: str) -> str:
    """CTEs up to ``g``: complete hourly grid with its split."""
    return f"""
raw AS (SELECT CAST({series} AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, value FROM events),
span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM raw),
hours AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
names AS (SELECT DISTINCT series_id FROM raw),
sums AS (SELECT series_id, ts, sum(value) AS load, count(*) AS n_obs FROM raw GROUP BY series_id, ts),
g0 AS (
  SELECT c.series_id, c.ts, coalesce(s.load, 0.0) AS load, CAST(coalesce(s.n_obs, 0) AS BIGINT) AS n_obs,
         row_number() OVER (PARTITION BY c.series_id ORDER BY c.ts) - 1 AS pos,
         count(*) OVER (PARTITION BY c.series_id) AS n
  FROM (SELECT series_id, ts FROM names CROSS JOIN hours) c LEFT JOIN sums s USING (series_id, ts)),
g1 AS (SELECT *, CASE WHEN pos < n * 70 // 100 THEN 'train' WHEN pos < n * 85 // 100 THEN 'val'
                      ELSE 'test' END AS split FROM g0),
g AS (SELECT *, row_number() OVER (PARTITION BY series_id, split ORDER BY ts) - 1 AS split_pos,
             count(*) OVER (PARTITION BY series_id, split) AS split_n FROM g1)"""


def first_hours(k: int) -> str:
    """Condition for the first k hours of the span."""
    return f"ts < (SELECT lo FROM span) + INTERVAL {k} HOUR"


def frame(series: str, weekly: int = 168, history: int = 48) -> str:
    """CTEs up to ``f``: long targets with naive forecasts."""
    return grid(series) + f""",
t AS (SELECT *, greatest(lag(load, 24) OVER w, 0.0) AS naive_24, lag(load, {weekly}) OVER w AS lw
      FROM g WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
f AS (
  SELECT series_id, split, ts, CAST(h AS INTEGER) AS h, split_pos - h - {history - 1} AS origin_idx,
         split_n - {history + 23} AS n_origins, load AS y, naive_24,
         greatest(coalesce(lw, naive_24), 0.0) AS naive_168,
         CASE WHEN lw IS NULL THEN naive_24 ELSE 0.6 * naive_24 + 0.4 * greatest(lw, 0.0) END AS naive_dual
  FROM t CROSS JOIN (SELECT unnest(range(1, 25)) AS h) hs
  WHERE split_pos - h >= {history - 1} AND split_pos - h + 24 < split_n)"""


def long(series: str) -> str:
    """CTEs up to ``p``: one row per naive model and cell."""
    return frame(series) + """,
p AS (
  SELECT series_id, split, origin_idx, n_origins, h, y, 'naive_24' AS model, naive_24 AS y_pred FROM f
  UNION ALL SELECT series_id, split, origin_idx, n_origins, h, y, 'naive_168', naive_168 FROM f
  UNION ALL SELECT series_id, split, origin_idx, n_origins, h, y, 'naive_dual', naive_dual FROM f)"""


SCORES = {
    "mae": "avg(abs(y - y_pred))",
    "rmse": "sqrt(avg((y - y_pred) * (y - y_pred)))",
    "mape": "avg(abs(y - y_pred) / (abs(y) + 1e-8)) * 100",
    "r2": "1 - sum((y - y_pred) ** 2) / (var_pop(y) * count(*) + 1e-8)",
    "smape": "200 * avg(abs(y - y_pred) / (abs(y) + abs(y_pred) + 1e-8))",
    "wape": "100 * sum(abs(y - y_pred)) / (sum(abs(y)) + 1e-8)",
    "mbe": "avg(y_pred - y)",
}
SCORE_LIST = ", ".join(f"{v} AS {k}" for k, v in SCORES.items())

HOLIDAY = "(month(ts) * 100 + day(ts)) IN (" + ", ".join(str(m * 100 + d) for m, d in HOLIDAYS) + ")"


def zone(free: str) -> str:
    return (f"CASE WHEN hour(ts) NOT BETWEEN 7 AND 22 THEN 'night' WHEN {free} THEN 'day' "
            "WHEN hour(ts) BETWEEN 10 AND 16 OR hour(ts) BETWEEN 21 AND 22 THEN 'peak' ELSE 'day' END")


WEEKEND = "isodow(ts) >= 6"
ZONE_ALL, ZONE_PLAIN = zone(f"{WEEKEND} OR {HOLIDAY}"), zone(WEEKEND)


def code(z: str) -> str:
    return f"CASE {z} WHEN 'night' THEN 0.0::DOUBLE WHEN 'peak' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"


def price(z: str) -> str:
    return f"CASE {z} WHEN 'night' THEN 1.8::DOUBLE WHEN 'peak' THEN 6.5::DOUBLE ELSE 4.2::DOUBLE END"


def angle(value: str, period: int) -> str:
    return f"(({value}) * 2 * {PI} / {period})"


# --- sources, calendar, tariff ---------------------------------------------------

ORACLES["hourly_grid_by_user"] = (
    f"WITH {grid('user_id')} SELECT series_id, ts, pos, n, {r('load')} AS load, n_obs FROM g")
for name in ("csv_roundtrip", "cached_grid"):
    ORACLES[name] = (
        f"WITH {grid('event_type')} SELECT series_id, ts, pos, n, {r('load')} AS load, n_obs FROM g")
ORACLES["row_contract"] = f"""
WITH {grid('user_id')}, b AS (SELECT date_diff('hour', lo, hi) + 1 AS expected FROM span)
SELECT series_id, count(*) AS n_rows, any_value(expected) AS expected,
       count(*) = any_value(expected) AS complete FROM g CROSS JOIN b GROUP BY series_id"""

ORACLES["hour_contract"] = """
WITH h AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS hr, count(*) AS k
           FROM events GROUP BY ALL)
SELECT series_id, count(hr) AS n_hours, date_diff('hour', min(hr), max(hr)) + 1 AS expected,
       CAST(coalesce(sum(k) FILTER (hr IS NOT NULL), 0) AS BIGINT) AS n_rows,
       CAST(coalesce(sum(k) FILTER (hr IS NULL), 0) AS BIGINT) AS n_dropped,
       series_id IS NOT NULL AND coalesce(count(hr) = date_diff('hour', min(hr), max(hr)) + 1, false)
         AND coalesce(sum(k) FILTER (hr IS NULL), 0) = 0 AS complete
FROM h GROUP BY series_id"""

SEASON = ("CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' "
          "WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END")
ORACLES["calendar_features"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, hour(ts) AS hh, isodow(ts) - 1 AS wd, dayofyear(ts) - 1 AS doy,
             max(load) OVER (PARTITION BY series_id) AS top FROM g)
SELECT series_id, ts, CAST(hh AS INTEGER) AS hour, CAST(wd AS INTEGER) AS weekday,
  CAST(wd >= 5 AS INTEGER) AS is_weekend, CAST(doy AS INTEGER) AS day_of_year,
  CAST(month(ts) AS INTEGER) AS month, {SEASON} AS season, CAST({HOLIDAY} AS INTEGER) AS is_holiday,
  CAST(month(ts) = 1 AND day(ts) <= 8 AS INTEGER) AS is_new_year,
  {r(f"sin({angle('hh', 24)})")} AS hour_sin, {r(f"cos({angle('hh', 24)})")} AS hour_cos,
  {r(f"sin({angle('wd', 7)})")} AS dow_sin, {r(f"cos({angle('wd', 7)})")} AS dow_cos,
  {r(f"sin({angle('doy - 1', 365)})")} AS month_sin, {r(f"cos({angle('doy - 1', 365)})")} AS month_cos,
  {r("doy / 364.0::DOUBLE")} AS doy_norm,
  {r(f"sin({angle('hh', 24)})")} AS cov_hour_sin, {r(f"cos({angle('hh', 24)})")} AS cov_hour_cos,
  {r("wd / 6.0::DOUBLE")} AS cov_weekday, CAST(wd >= 5 AS DOUBLE) AS cov_weekend,
  {r("load / (top + 1)")} AS load_norm FROM d"""

ORACLES["tariff_zone"] = f"""
WITH {grid('event_type')},
z AS (SELECT series_id, ts, {ZONE_ALL} AS za, {ZONE_PLAIN} AS zp FROM g)
SELECT series_id, ts, za AS tariff_zone, {code('za')} AS tariff_enc, {price('za')} AS price,
  CAST(za = 'peak' AS INTEGER) AS is_peak, CAST(za = 'night' AS INTEGER) AS is_night,
  zp AS plain_tariff_zone, {code('zp')} AS plain_tariff_enc, {price('zp')} AS plain_price,
  CAST(zp = 'peak' AS INTEGER) AS plain_is_peak, CAST(zp = 'night' AS INTEGER) AS plain_is_night FROM z"""
ORACLES["tariff_fallback"] = f"""
WITH {grid('event_type')}, z AS (SELECT series_id, ts, {ZONE_PLAIN} AS zp FROM g)
SELECT series_id, ts, {code('zp')} AS tariff_enc FROM z"""

ORACLES["weather_features"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, n_obs * 5.0::DOUBLE AS t, least(load, 100.0::DOUBLE) AS hu, (n_obs % 12)::DOUBLE AS wi FROM g),
m AS (SELECT series_id, max(t * t) AS top FROM d WHERE split = 'train' GROUP BY series_id),
e AS (SELECT d.*, top, 1 / (1 + exp(-greatest(-20.0, least(20.0, (hu - 60.0::DOUBLE) / 10)))) AS sg
      FROM d JOIN m USING (series_id))
SELECT series_id, ts, {r("greatest(0.0, 18.0::DOUBLE - t)")} AS heating,
  {r("greatest(0.0, t - 24.0::DOUBLE)")} AS cooling,
  {r("least(1.5::DOUBLE, t * t / (top + 1e-8))")} AS temperature_sq,
  {r('''1 + 2.5e-4::DOUBLE * (t - 18) ** 2 + CASE WHEN t > 22 THEN 0.3::DOUBLE * sg ELSE 0 END
     + CASE WHEN t < 10 THEN 0.15::DOUBLE * ln(1 + wi) ELSE 0 END
     + CASE WHEN t > 28 AND hu > 68 AND wi > 6 THEN 0.07::DOUBLE * sg * ln(1 + wi) / 4 ELSE 0 END''')} AS response,
  {r("1 + 0.05::DOUBLE * pos / (24 * 365.25::DOUBLE)")} AS trend,
  {r(f"1.025::DOUBLE + 0.125::DOUBLE * cos({angle('dayofyear(ts) - 1', 365)})")} AS drift,
  {r("exp(-((hour(ts) - 19.0::DOUBLE) ** 2) / 12.5::DOUBLE)")} AS evening FROM e"""

# --- split, quality ------------------------------------------------------------------

ORACLES["split"] = (
    f"WITH {grid('user_id')} SELECT series_id, ts, split, split_pos, split_n FROM g")
ORACLES["head_slices"] = f"""
WITH {grid('user_id')}
SELECT series_id, CAST(k AS INTEGER) AS hours, {r('sum(load)')} AS total
FROM g JOIN (SELECT unnest([24, 168, 720]) AS k) ks ON pos < k GROUP BY series_id, k"""

ORACLES["quality_report"] = f"""
WITH {grid('user_id')},
m AS (SELECT series_id, avg(load) AS mu, var_pop(load) AS v, count(*) AS cnt,
        count(*) FILTER (WHERE load IS NULL OR isnan(load) OR isinf(load)) AS bad,
        count(*) FILTER (WHERE load < 0) AS neg,
        avg(load) FILTER (WHERE {WEEKEND}) / avg(load) FILTER (WHERE NOT ({WEEKEND})) AS wr,
        avg(load) FILTER (WHERE month(ts) IN (12, 1, 2)) - avg(load) FILTER (WHERE month(ts) IN (6, 7, 8)) AS ws,
        stddev_samp(load) / avg(load) AS cv FROM g GROUP BY series_id),
hp AS (SELECT series_id, hour(ts) AS h, round(avg(load), 9) AS mean FROM g GROUP BY series_id, h),
mp AS (SELECT series_id, h AS mh FROM hp WHERE h BETWEEN 6 AND 11
       QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mean DESC, h) = 1),
ep AS (SELECT series_id, h AS eh FROM hp WHERE h BETWEEN 17 AND 22
       QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mean DESC, h) = 1),
dm AS (SELECT series_id, ts, load - mu AS x, v FROM g JOIN m USING (series_id)),
lg AS (SELECT series_id, v, x * lag(x, 24) OVER w AS p24, x * lag(x, 168) OVER w AS p168 FROM dm
       WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
ac AS (SELECT series_id, avg(p24) / (any_value(v) + 1e-10) AS a24, avg(p168) / (any_value(v) + 1e-10) AS a168
       FROM lg GROUP BY series_id),
a AS (SELECT * FROM m JOIN mp USING (series_id) JOIN ep USING (series_id) JOIN ac USING (series_id)),
o AS (
  SELECT series_id, 'nan_inf' AS "check", bad::DOUBLE AS value, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status FROM a
  UNION ALL SELECT series_id, 'negative', neg::DOUBLE, CASE WHEN neg = 0 THEN 'pass' ELSE 'fail' END FROM a
  UNION ALL SELECT series_id, 'morning_peak', mh::DOUBLE, 'pass' FROM a
  UNION ALL SELECT series_id, 'evening_peak', eh::DOUBLE, 'pass' FROM a
  UNION ALL SELECT series_id, 'weekend_ratio', wr, 'info' FROM a
  UNION ALL SELECT series_id, 'winter_over_summer', ws,
    CASE WHEN ws IS NULL THEN 'info' WHEN ws > 0 THEN 'pass' ELSE 'warn' END FROM a
  UNION ALL SELECT series_id, 'acf_24', a24, CASE WHEN a24 >= 0.35 THEN 'pass' ELSE 'warn' END FROM a
  UNION ALL SELECT series_id, 'acf_168', a168,
    CASE WHEN cnt < 336 THEN 'info' WHEN a168 >= 0.15 THEN 'pass' ELSE 'warn' END FROM a
  UNION ALL SELECT series_id, 'cv', cv, 'info' FROM a)
SELECT series_id, "check", {r('value')} AS value, status FROM o"""

ORACLES["drift_check"] = f"""
WITH {grid('user_id')},
d AS (SELECT series_id, avg(load) FILTER (WHERE split = 'train') AS mean_train,
             avg(load) FILTER (WHERE split = 'test') AS mean_test FROM g GROUP BY series_id)
SELECT series_id, {rr('mean_train', 'mean_test')}, mean_test / mean_train > 1.15 AS drift FROM d"""

ORACLES["alignment_check"] = f"""
WITH {frame('event_type')}
SELECT count(*) FILTER (WHERE naive_24 > 0) AS matched,
       count(*) FILTER (WHERE NOT naive_24 > 0) AS only_truth, CAST(0 AS BIGINT) AS only_pred
FROM f WHERE split = 'test'"""
ORACLES["joined_scores"] = f"""
WITH {frame('event_type')},
s AS (SELECT series_id, count(*) AS n, {SCORE_LIST} FROM (
  SELECT *, naive_24 AS y_pred FROM f WHERE split = 'test' AND naive_24 > 0) q GROUP BY series_id)
SELECT series_id, n, {rr(*SCORES)} FROM s"""

# --- profiles ----------------------------------------------------------------------------

ORACLES["describe"] = f"""
WITH {grid('user_id')},
d AS (SELECT series_id, count(*) AS count, avg(load) AS mean, stddev_samp(load) AS std, min(load) AS min,
  max(load) AS max, quantile_cont(load, 0.25) AS q25, quantile_cont(load, 0.5) AS q50,
  quantile_cont(load, 0.75) AS q75 FROM g GROUP BY series_id)
SELECT series_id, count, {rr('mean', 'std', 'min', 'max', 'q25', 'q50', 'q75')} FROM d"""
ORACLES["moments"] = f"""
WITH {grid('user_id')},
d AS (SELECT series_id, count(*) AS n, stddev_samp(load) / avg(load) AS cv, skewness(load) AS skew,
             kurtosis(load) AS kurt FROM g GROUP BY series_id)
SELECT series_id, n, {rr('cv', 'skew', 'kurt')} FROM d"""
ORACLES["hour_profile"] = f"""
WITH {grid('user_id')} SELECT series_id, CAST(hour(ts) AS INTEGER) AS hour, {r('avg(load)')} AS mean_load
FROM g GROUP BY series_id, hour(ts)"""
ORACLES["weekday_profile"] = f"""
WITH {grid('user_id')} SELECT series_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
{r('avg(load)')} AS mean_load FROM g GROUP BY series_id, isodow(ts)"""
ORACLES["hour_weekday_pivot"] = (
    f"WITH {grid('user_id')}, d AS (SELECT series_id, hour(ts) AS h, "
    + ", ".join(f"avg(load) FILTER (WHERE isodow(ts) = {k + 1}) AS wd{k}" for k in range(7))
    + " FROM g GROUP BY series_id, h) SELECT series_id, CAST(h AS INTEGER) AS hour, "
    + rr(*[f"wd{k}" for k in range(7)]) + " FROM d")


def histogram_sql(rows: str, value: str) -> str:
    """Histogram of ``value`` over the CTE ``rows``; finishes a WITH clause."""
    return f"""
hb AS (SELECT series_id, {value} AS x, min({value}) OVER (PARTITION BY series_id) AS lo,
              max({value}) OVER (PARTITION BY series_id) AS hi FROM {rows}),
hc AS (SELECT series_id, lo, (hi - lo) / 60 AS w,
         CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 60)) AS INTEGER), 59) END AS bin
       FROM hb),
hn AS (SELECT series_id, bin, any_value(lo) AS lo, any_value(w) AS w, count(*) AS count FROM hc
       GROUP BY series_id, bin),
hd AS (SELECT series_id, bin, lo + bin * w AS bin_left, count,
         CASE WHEN w > 0 THEN count / (sum(count) OVER (PARTITION BY series_id) * w) END AS density FROM hn)
SELECT series_id, bin, {rr('bin_left')}, count, {rr('density')} FROM hd"""


ORACLES["histogram"] = f"WITH {grid('event_type')}, {histogram_sql('g', 'load')}"
ORACLES["centre"] = f"""
WITH {grid('user_id')}
SELECT series_id, {r('avg(load)')} AS mean, {r('median(load)')} AS median FROM g GROUP BY series_id"""
ORACLES["value_bins"] = f"""
WITH {grid('event_type')},
e AS (SELECT *, min(n_obs) OVER (PARTITION BY series_id) AS lo, max(n_obs) OVER (PARTITION BY series_id) AS hi FROM g),
b AS (SELECT *, CAST(least(greatest(1, ceil((n_obs - lo) / ((hi - lo) / 36::DOUBLE))), 36) AS INTEGER) AS bin FROM e),
d AS (SELECT series_id, bin, count(*) AS count,
        any_value(lo + (bin - 0.5::DOUBLE) * (hi - lo) / 36::DOUBLE) AS mid, quantile_cont(load, 0.1) AS p10,
        quantile_cont(load, 0.5) AS median, quantile_cont(load, 0.9) AS p90 FROM b GROUP BY series_id, bin)
SELECT series_id, bin, count, {rr('mid', 'p10', 'median', 'p90')} FROM d"""
ORACLES["density_2d"] = f"""
WITH {grid('event_type')},
e AS (SELECT *, min(n_obs) OVER w AS bl, max(n_obs) OVER w AS bh, min(load) OVER w AS xl, max(load) OVER w AS xh
      FROM g WINDOW w AS (PARTITION BY series_id))
SELECT series_id, CAST(least(floor((n_obs - bl) / ((bh - bl) / 40::DOUBLE)), 39) AS INTEGER) AS bin_x,
  CAST(least(floor((load - xl) / ((xh - xl) / 40)), 39) AS INTEGER) AS bin_y, count(*) AS count
FROM e GROUP BY ALL"""

# --- features and windows ------------------------------------------------------------------

ORACLES["minmax"] = f"""
WITH {grid('user_id')},
m AS (SELECT series_id, min(load) AS lo, max(load) AS hi FROM g WHERE split = 'train' GROUP BY series_id),
d AS (SELECT series_id, ts, load, (load - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) AS scaled
      FROM g JOIN m USING (series_id))
SELECT series_id, ts, {rr('scaled')}, {r('load')} AS restored FROM d"""


def lag_fill(k: int) -> str:
    return (f"coalesce(lag(load, {k}) OVER w, CASE WHEN n > {k} THEN first_value(load) OVER w END, "
            f"median(load) OVER (PARTITION BY series_id))")


ORACLES["lags"] = (
    f"WITH {grid('user_id')}, d AS (SELECT series_id, ts, "
    + ", ".join(f"{lag_fill(k)} AS load_lag_{k}h" for k in (24, 48, 168))
    + " FROM g WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT series_id, ts, "
    + rr("load_lag_24h", "load_lag_48h", "load_lag_168h") + " FROM d")
ROLL = """
rl AS (SELECT *, avg(load) OVER q AS rm, coalesce(stddev_samp(load) OVER q, 0.0) AS rs FROM g
       WINDOW q AS (PARTITION BY series_id, split ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
ORACLES["rolling"] = f"""
WITH {grid('user_id')}, {ROLL}
SELECT series_id, ts, {r('rm')} AS rolling_mean_24h, {r('rs')} AS rolling_std_24h FROM rl"""


def features_sql() -> str:
    """CTEs up to ``ft``: the feature table by event type with temperature = 5 · count."""
    def sc(x: str, c: str = "load") -> str:
        return f"(({x}) - {c}_lo) / (CASE WHEN {c}_hi = {c}_lo THEN 1 ELSE {c}_hi - {c}_lo END)"

    def clip(x: str, hi: float) -> str:
        return f"least(greatest({x}, 0.0), {hi}::DOUBLE)"

    lags = ", ".join(f"{lag_fill(k)} AS lag{k}" for k in (24, 48, 168))
    return grid("event_type") + "," + ROLL + f""",
lf AS (SELECT *, n_obs * 5.0::DOUBLE AS temp, {ZONE_ALL} AS z, {lags} FROM rl
       WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
pr AS (SELECT series_id, min(load) AS load_lo, max(load) AS load_hi, min(temp) AS temp_lo, max(temp) AS temp_hi,
              min(rs) AS rs_lo, max(rs) AS rs_hi, max(temp * temp) AS t2 FROM lf WHERE split = 'train'
       GROUP BY series_id),
ft AS (
  SELECT series_id, ts, pos, split, split_pos, split_n, {sc('load')} AS consumption,
    sin({angle('hour(ts)', 24)}) AS hour_sin, cos({angle('hour(ts)', 24)}) AS hour_cos,
    CAST(z = 'peak' AS DOUBLE) AS is_peak, CAST(z = 'night' AS DOUBLE) AS is_night,
    CAST({WEEKEND} AS DOUBLE) AS is_weekend, CAST({HOLIDAY} AS DOUBLE) AS is_holiday,
    {sc('temp', 'temp')} AS temperature, {clip('temp * temp / (t2 + 1e-8)', 1.5)} AS temperature_sq,
    {code('z')} AS tariff_enc, (dayofyear(ts) - 1) / 364.0::DOUBLE AS doy_norm,
    0.0::DOUBLE AS humidity, 0.0::DOUBLE AS wind_speed,
    {clip(sc('rm'), 1)} AS rolling_mean_24h, {clip(sc('rs', 'rs'), 1)} AS rolling_std_24h,
    {clip(sc('lag24'), 1.5)} AS lag_24h, {clip(sc('lag48'), 1.5)} AS lag_48h, {clip(sc('lag168'), 1.5)} AS lag_168h,
    sin({angle('isodow(ts) - 1', 7)}) AS dow_sin, cos({angle('isodow(ts) - 1', 7)}) AS dow_cos,
    sin({angle('dayofyear(ts) - 2', 365)}) AS month_sin, cos({angle('dayofyear(ts) - 2', 365)}) AS month_cos,
    0.0::DOUBLE AS cloud_cover, 0.0::DOUBLE AS ev_load_norm, 0.0::DOUBLE AS solar_gen_norm,
    0.0::DOUBLE AS dsr_active, load_lo AS consumption_min, load_hi AS consumption_max
  FROM lf JOIN pr USING (series_id))"""


FEATURE_COLUMNS = (
    "consumption", "hour_sin", "hour_cos", "is_peak", "is_night", "is_weekend", "is_holiday",
    "temperature", "temperature_sq", "tariff_enc", "doy_norm", "humidity", "wind_speed",
    "rolling_mean_24h", "rolling_std_24h", "lag_24h", "lag_48h", "lag_168h", "dow_sin", "dow_cos",
    "month_sin", "month_cos", "cloud_cover", "ev_load_norm", "solar_gen_norm", "dsr_active")
ORACLES["feature_table"] = (
    f"WITH {features_sql()} SELECT series_id, ts, pos, split, "
    f"{rr(*FEATURE_COLUMNS, 'consumption_min', 'consumption_max')} FROM ft")
ORACLES["covariate_selection"] = (
    f"WITH {features_sql()} SELECT series_id, ts, {rr('consumption', *COVARIATES)} FROM ft")
ORACLES["window_integrity"] = f"""
WITH {features_sql()},
d AS (SELECT series_id, split, count(*) - 71 AS n_windows,
        max(consumption) FILTER (WHERE split_pos >= 48) AS y_max FROM ft GROUP BY series_id, split)
SELECT series_id, split, n_windows, CAST(0 AS BIGINT) AS n_bad, {rr('y_max')},
  CASE WHEN y_max > 1.5 THEN 'fail' WHEN y_max > 1.05 THEN 'warn' ELSE 'pass' END AS status FROM d"""
ORACLES["window_counts"] = f"""
WITH {grid('user_id')}
SELECT series_id, split, count(*) AS n_rows, greatest(count(*) - 48 - 24 + 1, 0) AS n_windows
FROM g GROUP BY series_id, split"""
ORACLES["sliding_windows"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, count(*) OVER h AS steps, sum(load) OVER h AS x_total, first_value(n_obs) OVER h AS fo,
        lead(load, 1) OVER w AS y_first, lead(load, 24) OVER w AS y_last FROM g
      WINDOW w AS (PARTITION BY series_id, split ORDER BY ts),
             h AS (PARTITION BY series_id, split ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT series_id, split, ts AS origin_ts, split_pos - 47 AS origin_idx, CAST(steps AS INTEGER) AS steps,
  {rr('x_total')}, fo::DOUBLE AS first_obs, {rr('y_first', 'y_last')}
FROM d WHERE steps = 48 AND y_last IS NOT NULL"""
ORACLES["flattened_windows"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, count(*) OVER h AS steps, first_value(load) OVER h AS first, max(load) OVER h AS tl,
        max(n_obs) OVER h AS tn, lead(load, 24) OVER w AS y_last FROM g
      WINDOW w AS (PARTITION BY series_id, split ORDER BY ts),
             h AS (PARTITION BY series_id, split ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT series_id, ts AS origin_ts, CAST(96 AS INTEGER) AS width, {rr('first')},
  {r('greatest(tl, tn::DOUBLE)')} AS top FROM d WHERE steps = 48 AND y_last IS NOT NULL"""
ORACLES["window_covariates"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, lag(n_obs, 47) OVER w AS fo, lead(load, 24) OVER w AS y_last FROM g
      WINDOW w AS (PARTITION BY series_id, split ORDER BY ts))
SELECT series_id, ts AS origin_ts, CAST(48 AS INTEGER) AS steps, hour(ts)::DOUBLE AS last_hour,
  n_obs::DOUBLE AS last_obs, fo::DOUBLE AS first_obs FROM d WHERE fo IS NOT NULL AND y_last IS NOT NULL"""
ORACLES["targets"] = f"""
WITH {frame('event_type')} SELECT series_id, split, ts, h, origin_idx, {r('y')} AS y FROM f"""
ORACLES["seasonal_naive"] = f"""
WITH {frame('event_type')},
m AS (SELECT series_id, min(load) AS lo, max(load) AS hi FROM g WHERE split = 'train' GROUP BY series_id)
SELECT series_id, ts, h, origin_idx, {rr('naive_24', 'naive_168', 'naive_dual')},
  {r('(y - naive_dual) / (hi - lo)')} AS y_diff,
  {r('greatest((y - lo) / (hi - lo), 0.0) * (hi - lo) + lo')} AS rebuilt FROM f JOIN m USING (series_id)"""
ORACLES["naive_window_lag"] = f"""
WITH {frame('event_type', weekly=48)} SELECT series_id, ts, h, {rr('naive_168', 'naive_dual')} FROM f"""


def lag_features_sql(channels: tuple[str, ...]) -> str:
    def over(width: int) -> str:
        return f"OVER f{width}"

    cols = {f"load_t{k}": f"lag(consumption, {k}) OVER w" for k in range(47, -1, -1)}
    cols |= {f"load_mean{w}": f"avg(consumption) {over(w)}" for w in (3, 6, 12, 24)}
    cols |= {f"load_std{w}": f"stddev_pop(consumption) {over(w)}" for w in (6, 24)}
    cols |= {"load_min24": f"min(consumption) {over(24)}", "load_max24": f"max(consumption) {over(24)}",
             "load_range24": f"max(consumption) {over(24)} - min(consumption) {over(24)}"}
    cols |= {f"load_d{k}": f"consumption - lag(consumption, {k}) OVER w" for k in (1, 3, 24)}
    cols["load_ratio24"] = "consumption / (lag(consumption, 24) OVER w + 1e-8)"
    cols |= {f"{c}_last": c for c in channels if c != "consumption"}
    cols |= {f"{c}_rm{w}": f"avg({c}) {over(w)}" for w in (6, 12, 24, 48) for c in channels}
    cols |= {f"{c}_rs{w}": f"stddev_pop({c}) {over(w)}" for w in (6, 24) for c in channels}
    part = "PARTITION BY series_id, split ORDER BY ts"
    frames = ", ".join(f"f{w} AS ({part} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
                       for w in (3, 6, 12, 24, 48))
    return (f"WITH {features_sql()}, d AS (SELECT series_id, split, ts, split_pos, split_n, "
            + ", ".join(f"{v} AS {k}" for k, v in cols.items())
            + f" FROM ft WINDOW w AS ({part}), {frames}) "
            "SELECT series_id, split, ts AS origin_ts, split_pos - 47 AS origin_idx, "
            + rr(*cols) + " FROM d WHERE split_pos >= 47 AND split_pos + 24 < split_n")


ORACLES["lag_features"] = lag_features_sql(FEATURE_COLUMNS)
ORACLES["patches"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, list(load) OVER h AS hist FROM g
      WINDOW h AS (PARTITION BY series_id, split ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
e AS (SELECT series_id, ts, k, list_avg(hist[k * 4 + 1 : k * 4 + 8]) AS patch_mean
      FROM d CROSS JOIN (SELECT unnest(range(0, 11)) AS k) ks
      WHERE split_pos >= 47 AND split_pos + 24 < split_n)
SELECT series_id, ts AS origin_ts, CAST(k AS INTEGER) AS patch_no, {rr('patch_mean')} FROM e"""
ORACLES["instance_norm"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, avg(load) OVER h AS win_mean, stddev_pop(load) OVER h AS win_std FROM g
      WINDOW h AS (PARTITION BY series_id, split ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT series_id, ts, {rr('win_mean', 'win_std')}, {r('(load - win_mean) / (win_std + 1e-6)')} AS normed,
  {r('load')} AS restored FROM d WHERE split_pos >= 47 AND split_pos + 24 < split_n"""
ORACLES["latest_window"] = f"""
WITH {grid('user_id')},
d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back,
             max(ts) OVER (PARTITION BY series_id) AS origin_ts FROM g)
SELECT series_id, origin_ts, CAST(48 - back AS INTEGER) AS step, {r('load')} AS load,
  n_obs::DOUBLE AS n_obs FROM d WHERE back <= 48"""

# --- evaluation ---------------------------------------------------------------------------------

ORACLES["metrics_by_model"] = f"""
WITH {long('user_id')},
s AS (SELECT series_id, model, count(*) AS n, {SCORE_LIST} FROM p WHERE split = 'test' GROUP BY series_id, model)
SELECT series_id, model, n, {rr(*SCORES)} FROM s"""
ORACLES["huber"] = f"""
WITH {long('event_type')},
d AS (SELECT series_id, model, split, avg(CASE WHEN abs(y - y_pred) <= 0.05 THEN (y - y_pred) ** 2 / 2
  ELSE 0.05::DOUBLE * (abs(y - y_pred) - 0.025::DOUBLE) END) AS huber FROM p GROUP BY series_id, model, split)
SELECT series_id, model, split, {rr('huber')} FROM d"""
ORACLES["distinct_models"] = f"WITH {long('event_type')} SELECT DISTINCT model FROM p"
ORACLES["bias_correction"] = f"""
WITH {long('user_id')},
b AS (SELECT series_id, model, avg(y_pred - y) AS bias FROM p WHERE split = 'val' GROUP BY series_id, model),
c AS (SELECT series_id, model, bias, y, y_pred - bias AS y_pred FROM p JOIN b USING (series_id, model)
      WHERE split = 'test'),
s AS (SELECT series_id, model, any_value(bias) AS bias, {SCORE_LIST} FROM c GROUP BY series_id, model)
SELECT series_id, model, {rr('bias', 'mae', 'rmse', 'mbe')} FROM s"""


def acf_sql(rows: str, lags: tuple[int, ...], keys: str, eps: str = "1e-12") -> str:
    """CTEs ending in ``ac``: acf_k per key over ``rows`` (keys, pos, resid)."""
    prods = ", ".join(f"x * lag(x, {k}) OVER w AS p{k}" for k in lags)
    outs = ", ".join(
        f"CASE WHEN count(*) > {k} THEN sum(p{k}) / (count(*) * (any_value(v) + {eps})) END AS acf_{k}"
        for k in lags)
    return f"""
am AS (SELECT *, avg(resid) OVER (PARTITION BY {keys}) AS mu, var_pop(resid) OVER (PARTITION BY {keys}) AS v FROM {rows}),
ax AS (SELECT *, resid - mu AS x FROM am),
al AS (SELECT *, resid - lag(resid, 1) OVER w AS step, {prods} FROM ax
       WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
ac AS (SELECT {keys}, count(*) AS n, sum(step * step) / (sum(resid * resid) + 1e-12) AS dw,
         avg(x ** 3) / any_value(v) ** 1.5 AS skewness, avg(x ** 4) / any_value(v) ** 2 AS kurtosis,
         {outs} FROM al GROUP BY {keys})"""


DIAG = (1, 24, 48, 168)
RANKED = long("user_id") + f""",
rs AS (SELECT series_id, model, origin_idx AS pos, y - y_pred AS resid FROM p WHERE split = 'test' AND h = 1),
{acf_sql('rs', DIAG, 'series_id, model')},
s AS (SELECT series_id, model, {SCORE_LIST} FROM p WHERE split = 'test' GROUP BY series_id, model),
k AS (SELECT s.*, ac.acf_24, 0.5 * mae + 0.3 * rmse + 0.2 * abs(coalesce(ac.acf_24, 0)) * mae AS composite
      FROM s JOIN ac USING (series_id, model))"""
ORACLES["leaderboard"] = f"""
WITH {RANKED}
SELECT series_id, model, CAST(row_number() OVER (PARTITION BY series_id ORDER BY coalesce(composite, 999), model)
  AS INTEGER) AS rank, {rr('composite', 'mae', 'rmse', 'acf_24')} FROM k"""
ORACLES["best_model"] = f"""
WITH {RANKED}
SELECT series_id, model AS best_model, {r('mae')} AS best_score FROM k
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mae, model) = 1"""
ORACLES["evaluate_flat"] = f"""
WITH {long('event_type')},
rs AS (SELECT series_id, model, row_number() OVER (PARTITION BY series_id, model ORDER BY origin_idx, h) AS pos,
              y - y_pred AS resid FROM p WHERE split = 'train'),
{acf_sql('rs', DIAG, 'series_id, model')},
s AS (SELECT series_id, model, {SCORE_LIST} FROM p WHERE split = 'train' GROUP BY series_id, model),
k AS (SELECT ac.*, 0.5 * mae + 0.3 * rmse + 0.2 * abs(acf_24) * mae AS composite
      FROM s JOIN ac USING (series_id, model))
SELECT series_id, model, {rr('dw', 'acf_24', 'acf_168', 'kurtosis', 'composite')} FROM k"""
BACKTEST = long("event_type") + f""",
bt AS (SELECT series_id, model, CAST(least(origin_idx // (37 // 8), 7) AS INTEGER) AS window_no, count(*) AS n,
         {SCORE_LIST} FROM p WHERE split = 'test' GROUP BY series_id, model, window_no)"""
ORACLES["backtest"] = (
    f"WITH {BACKTEST} SELECT series_id, model, window_no, n, {rr(*SCORES)} FROM bt")
BT = ("mae", "rmse", "mape", "r2")
ORACLES["backtest_summary"] = (
    f"WITH {BACKTEST} SELECT series_id, model, count(*) AS windows, "
    + ", ".join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std" for c in BT)
    + " FROM bt GROUP BY series_id, model")
ORACLES["fit_regime"] = f"""
WITH {long('user_id')},
d AS (SELECT series_id, model, avg(abs(y - y_pred)) FILTER (WHERE split = 'train') AS train_mae,
             avg(abs(y - y_pred)) FILTER (WHERE split = 'val') AS val_mae FROM p GROUP BY series_id, model),
e AS (SELECT *, val_mae - train_mae AS generalization_gap FROM d)
SELECT series_id, model, {rr('train_mae', 'val_mae')},
  CASE WHEN generalization_gap >= 0.5 AND train_mae < 3 THEN 'overfitting'
       WHEN train_mae >= 3 AND val_mae >= 3 THEN 'underfitting' ELSE 'balanced' END AS status,
  {rr('generalization_gap')} FROM e"""
ORACLES["prediction_spread"] = f"""
WITH {frame('event_type')}, d AS (SELECT *, (naive_24 + naive_168 + naive_dual) / 3 AS m FROM f)
SELECT series_id, split, origin_idx, h, CAST(3 AS BIGINT) AS samples, {r('m')} AS mean_pred,
  {r('sqrt(((naive_24 - m) ** 2 + (naive_168 - m) ** 2 + (naive_dual - m) ** 2) / 3)')} AS std_pred FROM d"""
ORACLES["forecast_views"] = f"""
WITH {frame('event_type')}
SELECT 'single' AS view, series_id, split, ts, h, {rr('y', 'naive_24')} FROM f WHERE origin_idx % 24 = 0
UNION ALL
SELECT 'walk', series_id, split, ts, h, {rr('y', 'naive_24')} FROM f WHERE h = 1"""
ORACLES["error_histogram"] = f"""
SELECT split_part(series_id, '|', 1) AS series_id, split_part(series_id, '|', 2) AS model,
       * EXCLUDE (series_id) FROM (
WITH {long('event_type')},
e AS (SELECT series_id || '|' || model AS series_id, y - y_pred AS err FROM p WHERE split = 'test'),
{histogram_sql('e', 'err')})"""
ORACLES["ensemble_fixed"] = f"""
WITH {frame('user_id')},
e AS (SELECT series_id, y, 0.5::DOUBLE * naive_24 + 0.3::DOUBLE * naive_168 + 0.2::DOUBLE * naive_dual AS y_pred
      FROM f WHERE split = 'test'),
s AS (SELECT series_id, count(*) AS n, {SCORE_LIST} FROM e GROUP BY series_id)
SELECT series_id, n, {rr(*SCORES)} FROM s"""
ORACLES["seasonal_blend"] = f"""
WITH {frame('event_type')},
c AS (SELECT a.i * 11 + b.j AS k, a.i / 10.0::DOUBLE AS w, b.j / 10.0::DOUBLE AS v
      FROM (SELECT unnest(range(0, 11)) AS i) a CROSS JOIN (SELECT unnest(range(0, 11)) AS j) b),
e AS (SELECT series_id, k, w, v,
        round(avg(abs(y - (v * (w * naive_dual + (1 - w) * naive_24) + (1 - v) * naive_168))), 9) AS mae
      FROM f CROSS JOIN c WHERE split = 'val' GROUP BY series_id, k, w, v),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mae, k) = 1),
t1 AS (SELECT series_id, avg(abs(y - (v * (w * naive_dual + (1 - w) * naive_24) + (1 - v) * naive_168))) AS test_mae
      FROM f JOIN b USING (series_id) WHERE split = 'test' GROUP BY series_id)
SELECT series_id, {rr('w', 'v', 'mae', 'test_mae')} FROM b JOIN t1 USING (series_id)"""

# --- residual analysis ------------------------------------------------------------------------------

ORACLES["acf"] = f"""
WITH {grid('event_type')},
m AS (SELECT series_id, pos, load - avg(load) OVER (PARTITION BY series_id) AS x FROM g),
z AS (SELECT series_id, sum(x * x) AS c0 FROM m GROUP BY series_id),
d AS (SELECT a.series_id, k, sum(a.x * b.x) AS c FROM m a CROSS JOIN (SELECT unnest(range(0, 201)) AS k) ks
      JOIN m b ON b.series_id = a.series_id AND b.pos = a.pos - k GROUP BY a.series_id, k)
SELECT series_id, CAST(k AS INTEGER) AS lag, {r('c / c0')} AS acf FROM d JOIN z USING (series_id)"""

# Durbin's recursion on lists; ``rho`` starts at lag 0, ``phi`` at lag 1.
ORACLES["pacf"] = f"""
WITH RECURSIVE {grid('event_type')},
m AS (SELECT series_id, pos, load - avg(load) OVER (PARTITION BY series_id) AS x FROM g),
d AS (SELECT a.series_id, k, sum(a.x * b.x) AS c FROM m a CROSS JOIN (SELECT unnest(range(0, 51)) AS k) ks
      JOIN m b ON b.series_id = a.series_id AND b.pos = a.pos - k GROUP BY a.series_id, k),
ac AS (SELECT series_id, list(c ORDER BY k) AS cs FROM d GROUP BY series_id),
rh AS (SELECT series_id, list_transform(cs, lambda c: c / cs[1]) AS rho FROM ac),
st AS (
  SELECT series_id, rho, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS pacf FROM rh
  UNION ALL
  SELECT series_id, rho, k + 1, list_append(
      list_transform(phi, lambda p, i: p - last * phi[k + 1 - i]), last), last
  FROM (SELECT *, (rho[k + 2] - coalesce(list_sum(list_transform(phi, lambda p, i: p * rho[k + 2 - i])), 0))
                  / (1 - coalesce(list_sum(list_transform(phi, lambda p, i: p * rho[i + 1])), 0)) AS last
        FROM st WHERE k < 50) nx)
SELECT series_id, CAST(k AS INTEGER) AS lag, {r('pacf')} AS pacf FROM st"""


def residual_sql(series: str) -> str:
    """CTEs up to ``rs``: day-ahead residuals numbered from 0."""
    return grid(series) + """,
l24 AS (SELECT series_id, pos, load - lag(load, 24) OVER (PARTITION BY series_id ORDER BY ts) AS resid FROM g),
rs AS (SELECT series_id, pos - 24 AS pos, resid FROM l24 WHERE resid IS NOT NULL)"""


ORACLES["residual_diagnostics"] = f"""
WITH {residual_sql('user_id')}, {acf_sql('rs', DIAG, 'series_id')}
SELECT series_id, n, {rr('dw', 'acf_1', 'acf_24', 'acf_48', 'acf_168', 'skewness', 'kurtosis')},
  concat_ws('; ', CASE WHEN dw < 1.5 THEN 'first-order autocorrelation' END,
    CASE WHEN abs(acf_24) > 0.10 THEN 'daily component left' END,
    CASE WHEN abs(acf_168) > 0.10 THEN 'weekly component left' END,
    CASE WHEN kurtosis > 5 THEN 'heavy tails: use a Huber loss' WHEN kurtosis > 3 THEN 'Huber loss in use' END)
  AS advice FROM ac"""
ORACLES["residual_summary"] = f"""
WITH {residual_sql('user_id')},
d AS (SELECT series_id, count(*) AS n, avg(resid) AS mean, stddev_pop(resid) AS std, min(resid) AS min,
             max(resid) AS max FROM rs GROUP BY series_id)
SELECT series_id, n, {rr('mean', 'std', 'min', 'max')}, std >= 1 AS testable FROM d"""
LB = tuple(range(1, 21))


def lb(m: int) -> str:
    return "n * (n + 2) * (" + " + ".join(f"acf_{k} * acf_{k} / (n - {k})" for k in range(1, m + 1)) + ")"


def chi2(x: str, df: int) -> str:
    terms = " + ".join(f"({x} / 2) ** {j} / {math.factorial(j)}::DOUBLE" for j in range(df // 2))
    return f"exp(-{x} / 2) * ({terms})"


ORACLES["ljung_box"] = f"""
WITH {residual_sql('user_id')}, {acf_sql('rs', LB, 'series_id', '0')},
d AS (SELECT series_id, n, {lb(10)} AS lb_10, {lb(20)} AS lb_20 FROM ac)
SELECT series_id, n, {rr('lb_10')}, {r(chi2('lb_10', 10))} AS lb_p_10, {rr('lb_20')},
  {r(chi2('lb_20', 20))} AS lb_p_20 FROM d"""
ORACLES["jarque_bera"] = f"""
WITH {residual_sql('user_id')}, {acf_sql('rs', (1,), 'series_id')},
d AS (SELECT series_id, n, n / 6.0::DOUBLE * (skewness ** 2 + (kurtosis - 3) ** 2 / 4) AS jb FROM ac)
SELECT series_id, n, {rr('jb')}, {r('exp(-jb / 2)')} AS jb_p FROM d"""

KPSS_P = "CASE WHEN kpss <= 0.347 THEN 0.10 " + " ".join(
    f"WHEN kpss <= {hi} THEN {p} + (kpss - {lo}) * ({q} - {p}) / ({hi} - {lo})"
    for lo, hi, p, q in ((0.347, 0.463, 0.10, 0.05), (0.463, 0.574, 0.05, 0.025),
                         (0.574, 0.739, 0.025, 0.01))) + " ELSE 0.01 END::DOUBLE"
ORACLES["kpss"] = f"""
WITH {residual_sql('event_type')},
x AS (SELECT series_id, pos, resid - avg(resid) OVER (PARTITION BY series_id) AS x,
             count(*) OVER (PARTITION BY series_id) AS n FROM rs),
gm AS (SELECT a.series_id, k, any_value(a.n) AS n, sum(a.x * b.x) AS c
       FROM x a CROSS JOIN (SELECT unnest(range(0, 120)) AS k) ks
       JOIN x b ON b.series_id = a.series_id AND b.pos = a.pos - k GROUP BY a.series_id, k),
au AS (SELECT series_id, any_value(n) AS n,
         sum(CASE WHEN k = 0 THEN c WHEN k <= floor(n ** (2 / 9.0::DOUBLE)) THEN 2 * c ELSE 0 END) AS s0,
         sum(CASE WHEN k BETWEEN 1 AND floor(n ** (2 / 9.0::DOUBLE)) THEN 2 * k * c ELSE 0 END) AS s1
       FROM gm GROUP BY series_id),
bw AS (SELECT series_id, n, least(CAST(floor(1.1447::DOUBLE * ((s1 / s0) ** 2) ** (1 / 3.0::DOUBLE)
         * n ** (1 / 3.0::DOUBLE)) AS BIGINT), n - 1) AS lags FROM au),
lr AS (SELECT series_id, any_value(bw.n) AS n, any_value(lags) AS lags,
         sum(CASE WHEN k = 0 THEN c WHEN k <= lags THEN 2 * c * (1 - k / (lags + 1)::DOUBLE) ELSE 0 END)
           / any_value(bw.n) AS s2 FROM gm JOIN bw USING (series_id) GROUP BY series_id),
cs AS (SELECT series_id, sum(x) OVER (PARTITION BY series_id ORDER BY pos) AS s FROM x),
et AS (SELECT series_id, sum(s * s) AS eta FROM cs GROUP BY series_id),
k AS (SELECT series_id, n, lags, eta / (n * n::DOUBLE) / s2 AS kpss FROM et JOIN lr USING (series_id))
SELECT series_id, n, lags, {rr('kpss')}, {r(KPSS_P)} AS kpss_p FROM k"""


def poly(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def ratio(x: str, table: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    return f"({poly(x, table[0])} / {poly(x, table[1])})"


ORACLES["qq_points"] = f"""
WITH {residual_sql('event_type')},
o AS (SELECT series_id, resid, row_number() OVER (PARTITION BY series_id ORDER BY resid) AS i,
             count(*) OVER (PARTITION BY series_id) AS n FROM rs),
q AS (SELECT *, CASE WHEN i = n THEN 0.5::DOUBLE ** (1.0::DOUBLE / n) WHEN i = 1 THEN 1 - 0.5::DOUBLE ** (1.0::DOUBLE / n)
                     ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS s FROM o),
e AS (SELECT *, s - 0.5::DOUBLE AS c, 0.180625::DOUBLE - (s - 0.5::DOUBLE) ** 2 AS a,
             sqrt(-ln(least(s, 1 - s))) - 1.6::DOUBLE AS b, sqrt(-ln(least(s, 1 - s))) - 5.0::DOUBLE AS d FROM q),
z AS (SELECT series_id, i, resid, CASE WHEN abs(c) <= 0.425 THEN c * {ratio('a', stats.AS241_CENTRE)}
        ELSE sign(c) * (CASE WHEN d <= 0 THEN {ratio('b', stats.AS241_MIDDLE)}
                             ELSE {ratio('d', stats.AS241_TAIL)} END) END AS theoretical FROM e)
SELECT series_id, i - 1 AS rank0, {rr('theoretical')}, {r('resid')} AS ordered FROM z"""
ORACLES["decomposition"] = f"""
WITH {grid('event_type')},
a AS (SELECT *, CASE WHEN count(*) OVER q = 25 THEN (sum(load) OVER q - (lag(load, 12) OVER w
        + lead(load, 12) OVER w) / 2) / 24 END AS trend FROM g
      WINDOW w AS (PARTITION BY series_id ORDER BY ts),
             q AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
ph AS (SELECT series_id, pos % 24 AS ph, avg(load - trend) AS raw FROM a GROUP BY series_id, pos % 24),
se AS (SELECT series_id, ph, raw - avg(raw) OVER (PARTITION BY series_id) AS seasonal FROM ph)
SELECT a.series_id, ts, {rr('trend', 'seasonal')}, {r('load - trend - seasonal')} AS resid
FROM a JOIN se ON a.series_id = se.series_id AND a.pos % 24 = se.ph"""

# --- scans and storage -----------------------------------------------------------------------------------

ORACLES["rebound"] = f"""
WITH {grid('event_type')},
d AS (SELECT *, CASE WHEN load > 200 THEN 1 ELSE 0 END AS flag FROM g),
e AS (SELECT series_id, pos, flag = 0 AND lag(flag) OVER (PARTITION BY series_id ORDER BY ts) > 0 AS edge FROM d),
k AS (SELECT series_id, pos + k AS pos, sum(0.12::DOUBLE * exp(-0.65::DOUBLE * k)) AS up
      FROM e CROSS JOIN (SELECT unnest(range(0, 4)) AS k) ks WHERE edge GROUP BY series_id, pos + k)
SELECT g.series_id, ts, {r('coalesce(up, 0.0)')} AS rebound FROM g LEFT JOIN k
ON g.series_id = k.series_id AND g.pos = k.pos"""
ORACLES["cascade"] = f"""
WITH RECURSIVE {grid('event_type')},
a AS MATERIALIZED (SELECT series_id, ts, pos, load > 1.35::DOUBLE * avg(load) OVER (PARTITION BY series_id) AS above FROM g),
sc AS (
  SELECT series_id, ts, pos, CASE WHEN above THEN 0.055::DOUBLE ELSE 0.0::DOUBLE END AS s FROM a WHERE pos = 0
  UNION ALL
  SELECT a.series_id, a.ts, a.pos, CASE WHEN above THEN least(s + 0.055::DOUBLE, 0.25::DOUBLE)
    ELSE greatest(s - 0.04::DOUBLE, 0.0::DOUBLE) END
  FROM sc JOIN a ON a.series_id = sc.series_id AND a.pos = sc.pos + 1)
SELECT series_id, ts, {r('1 + s')} AS cascade FROM sc"""
ORACLES["stress"] = f"""
WITH RECURSIVE {grid('event_type')},
a AS MATERIALIZED (SELECT series_id, ts, pos,
  0.4::DOUBLE * least(1.4::DOUBLE, abs(n_obs * 5 - 18.0::DOUBLE) / 22)
  + CASE WHEN hour(ts) IN (7, 8, 9, 18, 19, 20, 21) THEN 0.25::DOUBLE ELSE 0 END
  + 0.25::DOUBLE * load / (max(load) OVER (PARTITION BY series_id) + 1)
  + CASE WHEN {WEEKEND} THEN 0.1::DOUBLE ELSE 0 END AS push FROM g),
sc AS (
  SELECT series_id, ts, pos, least(greatest(0.1::DOUBLE * push, 0.0::DOUBLE), 1.4::DOUBLE) AS s FROM a WHERE pos = 0
  UNION ALL
  SELECT a.series_id, a.ts, a.pos, least(greatest(0.9::DOUBLE * s + 0.1::DOUBLE * push, 0.0::DOUBLE), 1.4::DOUBLE)
  FROM sc JOIN a ON a.series_id = sc.series_id AND a.pos = sc.pos + 1)
SELECT series_id, ts, {r('s')} AS stress_state,
  {r('1 + 0.18::DOUBLE / (1 + exp(-greatest(-20.0, least(20.0, 6 * (s - 0.55::DOUBLE))))) + 0.06::DOUBLE * s * s')} AS stress
FROM sc"""

STRATEGY_ROWS = ", ".join(
    f"({i}, '{s.name}', {s.min_soc * 300.0!r}::DOUBLE, {s.max_soc * 300.0!r}::DOUBLE)"
    for i, s in enumerate(STRATEGIES))


def dispatch_sql(series: str) -> str:
    """Recursive CTEs up to ``dp``: the battery schedule."""
    return grid(series) + f""",
st AS (SELECT * FROM (VALUES {STRATEGY_ROWS}) AS v(ord, strategy, lo, hi)),
a AS MATERIALIZED (SELECT series_id, ts, pos, load, {ZONE_PLAIN} AS zone, {price(ZONE_PLAIN)} AS price FROM g),
-- The schedule depends on the clock only: one walk per strategy serves every series.
clock AS MATERIALIZED (SELECT DISTINCT pos, zone FROM a),
sc AS (
  SELECT CAST(-1 AS BIGINT) AS pos, ord, strategy, lo, hi, 150.0::DOUBLE AS soc_before, 0.0::DOUBLE AS ch,
         0.0::DOUBLE AS di, 150.0::DOUBLE AS soc FROM st
  UNION ALL
  SELECT q.pos, ord, strategy, lo, hi, soc, ch, di, least(greatest(soc + ch - di, 0.0::DOUBLE), 300.0::DOUBLE)
  FROM (SELECT c.pos, ord, strategy, lo, hi, soc,
          CASE WHEN zone = 'night' AND soc < hi - 0.1::DOUBLE THEN least(150.0::DOUBLE, hi - soc) ELSE 0.0::DOUBLE END AS ch,
          CASE WHEN zone = 'peak' AND soc > lo + 0.1::DOUBLE THEN least(150.0::DOUBLE, soc - lo) ELSE 0.0::DOUBLE END AS di
        FROM sc JOIN clock c ON c.pos = sc.pos + 1) q),
dp AS (SELECT a.*, ord, strategy, soc_before, soc, ch, di,
         CASE WHEN ch > 0 THEN 'charge' WHEN di > 0 THEN 'discharge' ELSE 'idle' END AS action,
         CASE WHEN di > 0 THEN greatest(0.0::DOUBLE, load - di * sqrt(0.95::DOUBLE))
              ELSE load + ch / sqrt(0.95::DOUBLE) END AS grid_kwh
       FROM a JOIN sc USING (pos))"""


ORACLES["dispatch"] = f"""
WITH RECURSIVE {dispatch_sql('event_type')}
SELECT series_id, strategy, ts, zone, {rr('soc_before', 'soc')}, action, {rr('grid_kwh')},
  {r('grid_kwh * price')} AS cost FROM dp"""
ORACLES["cumulative_savings"] = f"""
WITH RECURSIVE {dispatch_sql('event_type')},
c AS (SELECT *, sum((load - grid_kwh) * price) OVER (PARTITION BY series_id, strategy ORDER BY ts) AS cum_saved FROM dp)
SELECT series_id, strategy, ts, {rr('cum_saved')} FROM c"""
KPI = dispatch_sql("user_id") + """,
k0 AS (SELECT series_id, strategy, any_value(ord) AS ord, count(*) AS hours, sum(load * price) AS baseline_cost,
         sum(grid_kwh * price) AS optimized_cost,
         coalesce(max(load) FILTER (WHERE zone = 'peak'), max(load)) AS baseline_peak,
         coalesce(max(grid_kwh) FILTER (WHERE zone = 'peak'), max(grid_kwh)) AS optimized_peak,
         sum(ch + di) AS cycled_kwh, count(*) FILTER (WHERE action = 'charge') AS charge_hours,
         count(*) FILTER (WHERE action = 'discharge') AS discharge_hours FROM dp GROUP BY series_id, strategy),
k1 AS (SELECT *, greatest(0.0::DOUBLE, (baseline_peak - optimized_peak) * 950 * hours / 24 / 30.4375::DOUBLE) AS demand_savings,
         cycled_kwh * 0.06::DOUBLE AS degradation_cost, 3000000 * 0.015::DOUBLE * hours / 24 / 365.25::DOUBLE AS om_cost FROM k0),
k2 AS (SELECT *, baseline_cost - optimized_cost + demand_savings AS gross_savings,
         baseline_cost - optimized_cost + demand_savings - degradation_cost - om_cost AS net_savings FROM k1),
k AS (SELECT *, CASE WHEN baseline_cost > 0 THEN net_savings / baseline_cost * 100 ELSE 0 END AS net_pct,
        net_savings * 8760 / hours AS annual_savings FROM k2)"""
ORACLES["tariff_cost"] = f"""
WITH RECURSIVE {KPI}
SELECT series_id, strategy, hours, {rr('baseline_cost', 'optimized_cost', 'baseline_peak', 'optimized_peak',
  'cycled_kwh')}, charge_hours, discharge_hours, {rr('demand_savings', 'gross_savings', 'degradation_cost',
  'om_cost', 'net_savings', 'net_pct', 'annual_savings')},
  CASE WHEN annual_savings > 0 THEN {r('3000000 / annual_savings')} END AS payback_years FROM k"""
ORACLES["best_strategy"] = f"""
WITH RECURSIVE {KPI}
SELECT series_id, strategy AS best_strategy, {rr('net_pct')} FROM k
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY k.net_pct DESC, ord) = 1"""

# --- fitted models ------------------------------------------------------------------------------

ORACLES["seasonal_targets"] = f"""
WITH {grid('event_type')},
mm AS (SELECT series_id, min(load) AS lo, max(load) AS hi FROM g WHERE split = 'train' GROUP BY series_id),
sc AS (SELECT g.*, (load - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS x FROM g JOIN mm USING (series_id)),
nv AS (SELECT *, greatest(lag(x, 24) OVER (PARTITION BY series_id ORDER BY ts), 0.0) AS naive FROM sc),
tg AS (SELECT series_id, split, split_pos - h - 47 AS origin_idx, CAST(h AS INTEGER) AS h, x - naive AS y_diff, naive
       FROM nv CROSS JOIN (SELECT unnest(range(1, 25)) AS h) hs
       WHERE split_pos - h >= 47 AND split_pos - h + 24 < split_n)
SELECT series_id, split, origin_idx, h, {rr('y_diff', 'naive')} FROM tg"""

# --- series in runs, windows from stored blocks ----------------------------------------------------

ORACLES["runs"] = f"""
WITH {grid('user_id')},
i AS (SELECT *, pos - row_number() OVER (PARTITION BY series_id, n_obs > 0 ORDER BY pos) AS island FROM g)
SELECT series_id, pos AS start, CAST(1 AS BIGINT) AS length, n, {r('load')} AS load, n_obs FROM i WHERE n_obs > 0
UNION ALL SELECT series_id, min(pos), count(*), any_value(n), 0.0, 0 FROM i WHERE n_obs = 0 GROUP BY series_id, island"""
ORACLES["runs_dense"] = ORACLES["hourly_grid_by_user"]
for name in ("describe", "moments", "hour_profile", "weekday_profile", "hour_weekday_pivot"):
    ORACLES[f"runs_{name}"] = ORACLES[name]
ORACLES["runs_lags"] = (
    f"WITH {grid('user_id')}, d AS (SELECT series_id, pos, n, load, n_obs, "
    + ", ".join(f"lag(load, {k}) OVER w AS lag_{k}" for k in (1, 24, 48, 168))
    + " FROM g WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT series_id, pos, n, "
    + rr("load", *[f"lag_{k}" for k in (1, 24, 48, 168)]) + " FROM d WHERE n_obs > 0")
ORACLES["runs_acf"] = f"""
WITH {grid('user_id')}, rs AS (SELECT series_id, pos, load AS resid FROM g),
{acf_sql('rs', (1, 24, 48, 168), 'series_id', '0')}
SELECT series_id, n, {rr('acf_1', 'acf_24', 'acf_48', 'acf_168')} FROM ac"""

STORED = f"""WITH {features_sql()},
d AS (SELECT series_id, split, ts, split_pos, split_n, consumption, {{columns}},
        lead(consumption, 1) OVER w AS y_first, lead(consumption, 24) OVER w AS y_last FROM ft
      WINDOW w AS (PARTITION BY series_id, split ORDER BY ts),
             h AS (PARTITION BY series_id, split ORDER BY ts ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT series_id, split, ts AS origin_ts, split_pos - 47 AS origin_idx, {{out}} FROM d
WHERE split_pos >= 47 AND split_pos + 24 < split_n"""
ORACLES["stored_windows"] = STORED.format(
    columns=", ".join(f"avg({c}) OVER h AS {c}_mean, {c} AS {c}_last" for c in FEATURE_COLUMNS),
    out=rr(*[f"{c}_{s}" for c in FEATURE_COLUMNS for s in ("mean", "last")], "y_first", "y_last"))
ORACLES["stored_flat_windows"] = STORED.format(
    columns="first_value(consumption) OVER h AS first, greatest("
            + ", ".join(f"max({c}) OVER h" for c in FEATURE_COLUMNS) + ") AS top, ("
            + " + ".join(f"sum({c}) OVER h" for c in FEATURE_COLUMNS) + ") / 1248 AS total",
    out="CAST(1248 AS INTEGER) AS width, CAST(24 AS INTEGER) AS targets, " + rr("first", "top", "total"))
