"""Welch's t distribution and multiple-testing correction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    x, shift = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    while (small := x < 10).any():
        shift = np.where(small, shift + np.log(np.where(small, x, 1.0)), shift)
        x = np.where(small, x + 1, x)
    z = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / guard(1 - (p + q) * y / (p + 1))
    f = d.copy()
    for m in range(1, steps):
        for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / guard(1 + k * d)
            c = guard(1 + k / c)
            f *= c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
    out = np.where(y <= 0, 0.0, front * f)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """The chance of a |t| at least so large; 1 where it is not finite."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    with np.errstate(invalid="ignore", over="ignore"):
        p = incomplete_beta(dof / 2, np.full_like(dof, 0.5), dof / (dof + t * t))
    return np.where(np.isfinite(p), p, 1.0)


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: list[str], tie: str) -> DataFrame:
    """Adjusted p: the least of n/rank * p over all ranks from its own on, at most 1; non-finite p are left out of n and kept."""
    group = Window.partitionBy(*by)
    ranked = df.withColumn("_n", F.count(p).over(group)).withColumn("_r", F.row_number().over(group.orderBy(F.col(p).asc_nulls_last(), tie)))
    after = group.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(after)))).drop("_n", "_r")


def bonferroni(df: DataFrame, p: str, out: str, by: list[str]) -> DataFrame:
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.count(p).over(Window.partitionBy(*by))))


def guarded(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """top / bottom where bottom is above zero."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))
