"""Standard normal distribution as column expressions and for numpy arrays.

Spark has no error function. The distribution function uses the rational approximation of
J. Hart as given by G. West, "Better approximations to cumulative normal functions" (2005),
which is good to double precision.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the paper, highest power first.
NUMERATOR = [
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
DENOMINATOR = [
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
# Beyond this the tail is below 1e-14 and is taken as 0 (left) or 1 (right).
TAIL = 7.5
ROOT_TWO_PI = math.sqrt(2 * math.pi)


def horner(x, coefficients):
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], coefficients[0])


def norm_cdf(x: Column) -> Column:
    a = F.least(F.abs(x), F.lit(TAIL))
    tail = F.exp(a * a * F.lit(-0.5)) * horner(a, NUMERATOR) / horner(a, DENOMINATOR)
    tail = F.when(F.abs(x) >= TAIL, F.lit(0.0)).otherwise(tail)
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def pdf_array(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / ROOT_TWO_PI


def cdf_array(x: np.ndarray) -> np.ndarray:
    a = np.minimum(np.abs(x), TAIL)
    tail = np.exp(-0.5 * a * a) * horner(a, NUMERATOR) / horner(a, DENOMINATOR)
    tail = np.where(np.abs(x) >= TAIL, 0.0, tail)
    return np.where(x > 0, 1.0 - tail, tail)
