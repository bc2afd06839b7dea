"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- Fixed values: published tables ------------------------------------------

# Level-stationarity critical values and their p-values (Kwiatkowski et al., 1992).
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)

# Unit-root response surface with a constant, one variable (MacKinnon, 1994).
ADF_TAU_MIN, ADF_TAU_STAR, ADF_TAU_MAX = -18.83, -1.61, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

# Rational approximation of the normal quantile (Wichura, algorithm AS 241).
AS241_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
AS241_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
AS241_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Bias-adjusted skewness from the population one."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population one."""
    return F.when(n > 3, ((n + 1.0) * g2 + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))


def chi2_tail_even(x: Column, df: int) -> Column:
    """P(chi-square with an even number of degrees > x)."""
    if df % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    half = x / 2.0
    term = total = F.lit(1.0)
    for j in range(1, df // 2):
        term = term * half / float(j)
        total = total + term
    return F.exp(-half) * total


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Polynomial with coefficients in ascending order."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""
    q = p - 0.5
    near = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    centre = q * horner(near, AS241_CENTRE[0]) / horner(near, AS241_CENTRE[1])
    middle = horner(r - 1.6, AS241_MIDDLE[0]) / horner(r - 1.6, AS241_MIDDLE[1])
    tail = horner(r - 5.0, AS241_TAIL[0]) / horner(r - 5.0, AS241_TAIL[1])
    outer = F.when(r <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -outer).otherwise(outer))


def kpss_p(statistic: Column) -> Column:
    """p-value by linear interpolation, held at the table's ends."""
    out = F.lit(KPSS_P[-1])
    for i in range(len(KPSS_CRITICAL) - 1, 0, -1):
        lo, hi = KPSS_CRITICAL[i - 1], KPSS_CRITICAL[i]
        line = KPSS_P[i - 1] + (statistic - lo) * ((KPSS_P[i] - KPSS_P[i - 1]) / (hi - lo))
        out = F.when(statistic <= hi, line).otherwise(out)
    return F.when(statistic <= KPSS_CRITICAL[0], F.lit(KPSS_P[0])).otherwise(out)


# (upper limit of the absolute value, digits, shift). The shift keeps exact decimal
# ties, which averages of cents do produce, away from the rounding border.
TIDY_TIERS = (("1e6", 6, 3.14159e-8), ("1e9", 2, 3.14159e-4), ("1e12", -2, 3.14159))
TIDY_LAST = ("", -5, 3141.59)


def tidy(x: Column) -> Column:
    """Round for comparison across engines: fewer digits for larger values."""
    out = F.round(x + TIDY_LAST[2], TIDY_LAST[1])
    for top, digits, shift in reversed(TIDY_TIERS):
        out = F.when(F.abs(x) < float(top), F.round(x + shift, digits)).otherwise(out)
    return F.when(x.isNotNull(), out + F.lit(0.0))


def tidy_small(x: Column) -> Column:
    """:func:`tidy` for values known to stay below a million; a much shorter expression."""
    return F.round(x + TIDY_TIERS[0][2], TIDY_TIERS[0][1]) + F.lit(0.0)
