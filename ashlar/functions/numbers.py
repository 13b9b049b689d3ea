"""Numeric column expressions: normal distribution, seeded draws, p-values."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The p-value functions travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hart's rational approximation of the normal tail, as published by
# G. West, "Better approximations to cumulative normal functions", Wilmott 2005.
NORMAL_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
NORMAL_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
NORMAL_SWITCH = 7.07106781186547
NORMAL_SCALE = 2.506628274631


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    value = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        value = value * x + F.lit(coefficient)
    return value


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, about 15 digits, inside code generation."""
    x = F.abs(z)
    bell = F.exp(-x * x / 2)
    near = bell * _polynomial(x, NORMAL_NUMERATOR) / _polynomial(x, NORMAL_DENOMINATOR)
    fraction = x + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(step) / fraction
    far = bell / fraction / NORMAL_SCALE
    tail = F.when(x > 37.0, 0.0).when(x < NORMAL_SWITCH, near).otherwise(far)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def draw_digests(key: Column, seed: int, count: int) -> list[Column]:
    """The digests behind ``count`` draws per row, four draws to a digest."""
    return [
        F.md5(F.concat_ws("|", F.lit(str(seed)), key, F.lit(str(block))))
        for block in range((count + 3) // 4)
    ]


def gaussian_draws(digests: list[Column], count: int) -> list[Column]:
    """``count`` independent standard normal draws per row, by the Box-Muller transform.

    Seed and row key fix the digests and so the draws: they depend neither on partitioning
    nor on retries or file order. Pass digests that are columns already, not expressions,
    for each is used up to four times.
    """
    draws: list[Column] = []
    for digest in digests:
        for half in (1, 17):
            first, second = (
                (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 1) / 4294967297.0
                for start in (half, half + 8)
            )
            radius = F.sqrt(-2 * F.log(first))
            angle = 2 * math.pi * second
            draws += [radius * F.cos(angle), radius * F.sin(angle)]
    return draws[:count]


def _upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    if a > 1e7:  # the cube-root normal approximation is good to 1e-8 out here
        z = ((x / a) ** (1 / 3) - 1 + 1 / (9 * a)) * 3 * math.sqrt(a)
        return math.erfc(z / math.sqrt(2)) / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    fraction = d
    for i in range(1, 1_000_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        fraction *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * fraction


def _kolmogorov_small(d: float, n: int) -> float:
    """P(D_n < d) by Marsaglia, Tsang and Wang, J. Stat. Softw. 8 (2003)."""
    k = math.floor(n * d) + 1
    h = k - n * d
    size = 2 * k - 1
    matrix = np.tri(size, k=1)
    for i in range(size):
        matrix[i, 0] -= h ** (i + 1)
        matrix[size - 1, i] -= h ** (size - i)
    if 2 * h > 1:
        matrix[size - 1, 0] += (2 * h - 1) ** size
    for i in range(size):
        for j in range(max(0, i - size + 1), min(size, i + 1)):
            matrix[i, j] /= math.gamma(i - j + 2)
    power = np.linalg.matrix_power(matrix, n)
    return float(power[k - 1, k - 1] * math.exp(math.lgamma(n + 1) - n * math.log(n)))


def _kolmogorov_large(d: float, n: float) -> float:
    """P(D_n < d) by the Pelz-Good expansion, J. R. Stat. Soc. B 38 (1976)."""
    z = math.sqrt(n) * d
    z2 = z * z
    pi2 = math.pi**2
    half = (np.arange(-200, 200) + 0.5) ** 2 * pi2
    whole = np.arange(-200.0, 201.0) ** 2 * pi2
    at_half = np.exp(-half / (2 * z2))
    at_whole = np.exp(-whole / (2 * z2))
    front = math.sqrt(math.pi / 2)
    k0 = 2 * front / z * np.sum(at_half) / 2
    k1 = front / (6 * z2**2) * np.sum((half - z2) * at_half)
    k2 = front / (72 * z**7) * np.sum(
        ((6 * z2**3 + 2 * z2**2) + half * (2 * z2**2 - 5 * z2) + half**2 * (1 - 2 * z2)) * at_half
    ) - front / (36 * z**3) * np.sum(whole * at_whole)
    k3 = front / (6480 * z2**5) * np.sum(
        (
            half**3 * (5 - 30 * z2)
            + half**2 * (-60 * z2 + 212 * z2**2)
            + half * (135 * z2**2 - 96 * z2**3)
            - 30 * z2**3
            - 90 * z2**4
        )
        * at_half
    ) + front / (216 * z2**3) * np.sum((3 * whole * z2 - whole**2) * at_whole)
    return float(k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5)


def kolmogorov_survival(d: float, n: int) -> float:
    """P(D_n >= d) for the one-sample Kolmogorov-Smirnov statistic."""
    if n < 1 or d <= 0:
        return 1.0
    if d >= 1 or n * d * d > 370:
        return 0.0
    below = _kolmogorov_small(d, n) if n <= 140 else _kolmogorov_large(d, n)
    return min(1.0, max(0.0, 1 - below))


# Arrow-batched, applied to results with one row per column only.
@F.pandas_udf(T.DoubleType())
def chi2_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for statistic, freedom in batches:
        yield pd.Series(
            [None if pd.isna(s) else _upper_gamma(f / 2, s / 2) for s, f in zip(statistic, freedom)],
            dtype="float64",
        )


@F.pandas_udf(T.DoubleType())
def ks_p_value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for statistic, n in batches:
        yield pd.Series(
            [None if pd.isna(d) else kolmogorov_survival(d, int(m)) for d, m in zip(statistic, n)],
            dtype="float64",
        )
