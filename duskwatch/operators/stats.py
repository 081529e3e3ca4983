"""Grouped statistics and least-squares fits over long-form series, all as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ddof(pop: Column, n: Column, ddof: int) -> Column:
    """A population moment scaled to n - ddof (null where that is not positive)."""
    return F.when(n > ddof, pop * n / (n - ddof))


def series_stats(df: DataFrame, keys: list[str], x: str, y: str, ddof: int = 1, z: float = 1.96) -> DataFrame:
    """keys and ``n, mean, variance, std_dev, conf_low, conf_high, covariance, correlation`` (of y, and x with y)."""
    n = F.count(F.lit(1))
    a = df.groupBy(*keys).agg(n.alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("vy"), F.var_pop(x).alias("vx"), F.covar_pop(x, y).alias("cxy"))
    n = F.col("n")
    sd = F.sqrt(_ddof(F.col("vy"), n, ddof))
    return a.select(
        *keys,
        "n",
        "mean",
        _ddof(F.col("vy"), n, ddof).alias("variance"),
        sd.alias("std_dev"),
        (F.col("mean") - z * sd / F.sqrt("n")).alias("conf_low"),
        (F.col("mean") + z * sd / F.sqrt("n")).alias("conf_high"),
        _ddof(F.col("cxy"), n, ddof).alias("covariance"),
        F.try_divide("cxy", F.sqrt(F.col("vx") * F.col("vy"))).alias("correlation"),
    )


def fit_by(df: DataFrame, keys: list[str], x: str, y: str, x0: float = 0.0, t: float = 3.18245) -> DataFrame:
    """keys and ``n, m, b, best_m, best_b, sse, sigma, se, se_m, se_b, low, high``.

    ``m, b``: least squares; ``best_*``: 0 where the spread of x is under 1e-5; ``sse``: residuals
    summed over the rows (not from moments, which cancel); ``se``: standard error of a prediction
    at ``x0``; ``low, high``: its interval.  Fewer than three rows give null errors.
    """
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("m"), F.regr_intercept(y, x).alias("b"), F.avg(x).alias("x_mean"), F.regr_sxx(y, x).alias("sxx"), F.sum(F.col(x) * F.col(x)).alias("sum_xx"))
    residual = df.join(base.select(*keys, "m", "b"), keys).groupBy(*keys).agg(F.sum(F.pow(F.col(y) - (F.col("m") * F.col(x) + F.col("b")), 2)).alias("sse"))
    sigma = F.when(F.col("n") > 2, F.sqrt(F.col("sse") / (F.col("n") - 2)))
    out = base.join(residual, keys).withColumn("sigma", sigma)
    out = out.withColumn("se", F.col("sigma") * F.sqrt(1 + 1 / F.col("n") + F.try_divide(F.pow(F.lit(x0) - F.col("x_mean"), 2), "sxx")))
    flat = F.col("sxx") < 1e-5
    return out.select(
        *keys, "n", "m", "b",
        F.when(flat, 0.0).otherwise(F.col("m")).alias("best_m"),
        F.when(flat, 0.0).otherwise(F.col("b")).alias("best_b"),
        "sse", "sigma", "se",
        F.try_divide("sigma", F.sqrt("sxx")).alias("se_m"),
        (F.col("sigma") * F.sqrt(F.try_divide("sum_xx", F.col("n") * F.col("sxx")))).alias("se_b"),
        (F.col("b") + F.col("m") * x0 - t * F.col("se")).alias("low"),
        (F.col("b") + F.col("m") * x0 + t * F.col("se")).alias("high"),
    )


def student_t(degrees: int, tail: float = 0.025) -> float:
    """The value that Student's t exceeds with a chance of ``tail``, for whole degrees of freedom."""

    def inside(t: float) -> float:
        """Chance of a value between -t and t."""
        angle = math.atan(t / math.sqrt(degrees))
        cos2, odd = math.cos(angle) ** 2, degrees % 2
        term, total = (math.cos(angle) if odd else 1.0), 0.0
        for k in range(3 if odd else 2, degrees + 1, 2):
            total += term
            term *= cos2 * (k - 1) / k
        if not odd:
            return math.sin(angle) * total
        return 2 / math.pi * (angle + math.sin(angle) * total)

    low, high = 0.0, 1.0
    while inside(high) < 1 - 2 * tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < 1 - 2 * tail else (low, middle)
    return high


def products(xs: Column | str, ys: Column | str) -> Column:
    """Element by element product of two arrays."""
    return F.zip_with(xs, ys, lambda a, b: a * b)
