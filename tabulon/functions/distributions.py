"""Tail probabilities of a handful of driver-side scalars.

Spark ships commons-math3, so the special functions come from its JVM; the normal distribution
comes from the standard library. Upper tails are evaluated directly (never as 1 - cdf).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import SparkSession

NORMAL = NormalDist()
_HUGE_DOF = 1e8


def _special(spark: SparkSession):
    return spark._jvm.org.apache.commons.math3.special


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_two_sided(spark: SparkSession, t: float, dof: float) -> float:
    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if dof > _HUGE_DOF:
        return normal_two_sided(t)
    return float(_special(spark).Beta.regularizedBeta(float(dof / (dof + t * t)), float(dof / 2), 0.5))


def t_quantile(spark: SparkSession, p: float, dof: float) -> float:
    if dof > _HUGE_DOF:
        return NORMAL.inv_cdf(p)
    law = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(dof))
    return float(law.inverseCumulativeProbability(float(p)))


def f_upper(spark: SparkSession, f: float, dof1: float, dof2: float) -> float:
    if math.isnan(f) or dof1 <= 0 or dof2 <= 0:
        return math.nan
    if math.isinf(f):
        return 0.0
    if dof2 > _HUGE_DOF:
        return chi2_upper(spark, f * dof1, dof1)
    x = dof2 / (dof2 + dof1 * f)
    return float(_special(spark).Beta.regularizedBeta(float(x), float(dof2 / 2), float(dof1 / 2)))


def chi2_upper(spark: SparkSession, x: float, dof: float) -> float:
    if math.isnan(x) or dof <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    return float(_special(spark).Gamma.regularizedGammaQ(float(dof / 2), float(x / 2)))
