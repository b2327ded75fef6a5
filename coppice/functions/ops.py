"""Two engines for one formula: the same function builds a Spark Column or works on numpy arrays.

Losses and distribution gradients are written once against these names. On DataFrames they stay inside whole-stage
codegen; in training they run on blocks of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_SHIFT = 8


class _Columns:
    exp = staticmethod(F.exp)
    log = staticmethod(F.ln)
    abs = staticmethod(F.abs)
    sign = staticmethod(F.signum)
    sqrt = staticmethod(F.sqrt)

    @staticmethod
    def where(c, a, b):
        return F.when(c, a if isinstance(a, Column) else F.lit(a)).otherwise(b)

    @staticmethod
    def minimum(a, b):
        return F.least(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))

    @staticmethod
    def maximum(a, b):
        return F.greatest(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))

    @staticmethod
    def power(a, b):
        return F.pow(a, b)

    @staticmethod
    def full(like, value):
        return F.lit(float(value))


class _Arrays:
    exp, abs, sign, minimum, maximum, power, sqrt = np.exp, np.abs, np.sign, np.minimum, np.maximum, np.power, np.sqrt
    where = staticmethod(np.where)

    @staticmethod
    def log(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(x)

    @staticmethod
    def full(like, value):
        return np.full(np.shape(like), float(value))


COLUMNS, ARRAYS = _Columns(), _Arrays()


def engine(x):
    return COLUMNS if isinstance(x, Column) else ARRAYS


def clip(x, low, high):
    m = engine(x)
    return m.minimum(m.maximum(x, low), high)


def sigmoid(x):
    """1 / (1 + e^-x), stable on either side."""
    m = engine(x)
    e = m.exp(-m.abs(x))
    return m.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def softplus(x):
    m = engine(x)
    return m.maximum(x, 0.0) + m.log(1.0 + m.exp(-m.abs(x)))


def lgamma(x):
    """log Gamma for x > 0: eight recurrence steps, then Stirling's series."""
    m = engine(x)
    product = x
    for k in range(1, EULER_SHIFT):
        product = product * (x + float(k))
    z = x + float(EULER_SHIFT)
    i = 1.0 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / z
    return (z - 0.5) * m.log(z) - z + 0.5 * math.log(2 * math.pi) + series - m.log(product)


def digamma(x):
    m = engine(x)
    z = x + float(EULER_SHIFT)
    i = 1.0 / (z * z)
    out = m.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    for k in range(EULER_SHIFT):
        out = out - 1.0 / (x + float(k))
    return out


def trigamma(x):
    z = x + float(EULER_SHIFT)
    i = 1.0 / (z * z)
    out = 1.0 / z + 0.5 * i + i / z * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))
    for k in range(EULER_SHIFT):
        out = out + 1.0 / ((x + float(k)) * (x + float(k)))
    return out


#: Chebyshev coefficients of the complementary error function, relative error under 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erf(x):
    """Error function: on arrays by series and continued fraction, under 1e-9; on Columns by a polynomial that code
    generation can hold, under 1.2e-7."""
    m = engine(x)
    if m is COLUMNS:
        t = 1.0 / (1.0 + 0.5 * F.abs(x))
        inner = F.lit(ERFC[-1])
        for c in ERFC[-2::-1]:
            inner = c + t * inner
        return F.signum(x) * (1.0 - t * F.exp(-x * x + inner))
    a = np.minimum(np.abs(x), 6.0)
    term = total = a
    for n in range(1, 60):
        term = -term * a * a / n
        total = total + term / (2 * n + 1)
    low = 2 / math.sqrt(math.pi) * total
    b = np.maximum(a, 1.0)
    frac = b
    for k in range(60, 0, -1):
        frac = b + (k / 2.0) / frac
    high = 1.0 - np.exp(-b * b) / math.sqrt(math.pi) / frac
    return np.sign(x) * np.where(a < 2.5, low, high)


def normal_cdf(x):
    return 0.5 * (1.0 + erf(x / math.sqrt(2.0)))
