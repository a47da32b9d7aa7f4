"""Tests and effect sizes; aggregates in Spark, tails of distributions on the few numbers that result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def student_t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def paired_t(diff: Column) -> Column:
    """t of paired differences; null for fewer than two or without spread."""
    return F.try_divide(F.avg(diff), F.stddev_samp(diff) / F.sqrt(F.count(diff)))


def cohen_d(n1, m1, s1, n2, m2, s2) -> Column:
    """Difference of means over the pooled deviation; 0 for groups of one or without spread."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, n1 + n2 - 2))
    return F.when((n1 <= 1) | (n2 <= 1), 0.0).otherwise(F.coalesce(F.try_divide(m1 - m2, pooled), F.lit(0.0)))


def welch_t(n1, m1, s1, n2, m2, s2) -> tuple[Column, Column]:
    """t and degrees of freedom for groups of unlike spread."""
    a, b = s1 * s1 / n1, s2 * s2 / n2
    return F.try_divide(m1 - m2, F.sqrt(a + b)), F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, population deviation, extremes, sum and interpolated quartiles."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.sum(v).alias("sum"),
        *[F.percentile(v, F.lit(p / 100)).alias(f"p{p}") for p in (25, 50, 75)],
    )


def min_max(value: Column, window) -> Column:
    """To 0..1 within the window; 1 where all are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def improvement(base: Column, new: Column, percentage: bool = True) -> Column:
    return F.coalesce(F.try_divide(new - base, base), F.lit(0.0)) * (100 if percentage else 1)


def bootstrap_ci(a, b, rounds: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float]:
    """Mean and percentile interval of the mean paired difference over resamples; zeros for unequal or empty input."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) != len(b) or not len(a):
        return 0.0, 0.0, 0.0
    r = np.random.default_rng(seed)
    means = np.array([(a[i] - b[i]).mean() for i in (r.integers(0, len(a), len(a)) for _ in range(rounds))])
    return float(means.mean()), float(np.percentile(means, 100 * alpha / 2)), float(np.percentile(means, 100 * (1 - alpha / 2)))
