"""Scalar building blocks as Column expressions; no UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def saturation(x: Column, k: float) -> Column:
    """x / (x + k) for positive x, else 0."""
    return F.when(x > 0, x / (x + k)).otherwise(0.0)


def scaled_round(x: Column, digits: int) -> Column:
    """round() as SQL engines do it, by the scaled number. F.round goes by the decimal spelling of a double, which decides halves
    that binary fractions do not hold (1.005) the other way."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inv_norm_cdf(p: Column) -> Column:
    """Quantile of the standard normal distribution, p kept inside [1e-6, 1 - 1e-6]."""
    p = clamp(p, 1e-6, 1 - 1e-6)
    q = p - 0.5
    r = q * q
    middle = _horner(r, ACKLAM_A) * q / _horner(r, (*ACKLAM_B, 1.0))
    away = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(away, ACKLAM_C) / _horner(away, (*ACKLAM_D, 1.0))
    return F.when((p >= ACKLAM_LOW) & (p <= 1 - ACKLAM_LOW), middle).when(p < ACKLAM_LOW, tail).otherwise(-tail)


def computed_once(df, **values: Column):
    """df with columns whose values later filters and columns read, not spell out again: each a one-element array, expanded.

    A filter on a column is otherwise moved below its projection with the whole expression written out at every use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def months_between_boundaries(a: Column, b: Column) -> Column:
    """Month boundaries crossed from a to b, not whole months."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def working_days(first: Column, last: Column) -> Column:
    """Days from first to last, both included, without Sundays."""
    return F.size(F.filter(F.sequence(first, last), lambda d: F.dayofweek(d) != 1))


def half_open(day: Column, start: str, end: str) -> Column:
    """start <= day < end."""
    return (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))


# --- smoothers over an ARRAY<DOUBLE> of months, oldest first -------------------------------------------------------


def mean_of(series: Column) -> Column:
    return F.when(F.size(series) > 0, F.aggregate(series, F.lit(0.0), lambda a, x: a + x) / F.size(series)).otherwise(0.0)


def ewma(series: Column, alpha: float) -> Column:
    """Exponentially weighted level, started at the first value; never negative."""
    level = F.aggregate(F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0))), F.element_at(series, 1), lambda a, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * a)
    return F.when(F.size(series) > 0, F.greatest(F.lit(0.0), level)).otherwise(0.0)


def croston(series: Column, alpha: float, sba: bool) -> Column:
    """Demand size over demand interval, both smoothed at months with demand; the first interval counts from before the
    window. With fewer than two such months the mean. sba applies the bias correction 1 - alpha / 2."""
    start = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("p"), F.lit(-1).alias("prev"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def fold(acc: Column, x: Column) -> Column:
        gap = (acc["i"] - acc["prev"]).cast("double")
        first = acc["n"] == 0
        z = F.when(x <= 0, acc["z"]).when(first, x).otherwise(acc["z"] + F.lit(alpha) * (x - acc["z"]))
        p = F.when(x <= 0, acc["p"]).when(first, gap).otherwise(acc["p"] + F.lit(alpha) * (gap - acc["p"]))
        return F.struct(z.alias("z"), p.alias("p"), F.when(x > 0, acc["i"]).otherwise(acc["prev"]).alias("prev"), (acc["n"] + (x > 0).cast("int")).alias("n"), (acc["i"] + 1).alias("i"))

    factor = 1.0 - alpha / 2.0 if sba else 1.0
    rate = F.aggregate(series, start, fold, lambda a: F.when(a["n"] >= 2, a["z"] / a["p"] * F.lit(factor)))
    return F.coalesce(rate, mean_of(series))


def holt_path(series: Column, horizon: int, alpha: float = 0.4, beta: float = 0.2, phi: float = 0.85) -> Column:
    """Level and damped trend, projected for 1..horizon months and kept at or above 0."""
    first, second = F.element_at(series, 1), F.try_element_at(series, F.lit(2))
    start = F.struct(first.alias("l"), F.coalesce(second - first, F.lit(0.0)).alias("b"))

    def fold(acc: Column, x: Column) -> Column:
        level = F.lit(alpha) * x + F.lit(1 - alpha) * (acc["l"] + F.lit(phi) * acc["b"])
        return F.struct(level.alias("l"), (F.lit(beta) * (level - acc["l"]) + F.lit(1 - beta) * F.lit(phi) * acc["b"]).alias("b"))

    sums = F.array(*[F.lit(sum(phi**k for k in range(1, h + 1))) for h in range(1, horizon + 1)])
    return F.aggregate(F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0))), start, fold, lambda a: F.transform(sums, lambda s: F.greatest(F.lit(0.0), a["l"] + s * a["b"])))


def psi_term(actual: Column, expected: Column, least: float = 1e-6) -> Column:
    a, e = F.greatest(actual, F.lit(least)), F.greatest(expected, F.lit(least))
    return (a - e) * F.log(a / e)


def log_odds_points(pd: Column, pdo: float, offset: float) -> Column:
    return F.lit(offset) - F.lit(pdo / math.log(2)) * F.log(pd / (1 - pd))
