"""Normal distribution as columns: density, cumulative probability, quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal quantile (relative error below 1.2e-9).
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
QUANTILE_TAIL = 0.02425
# Coefficients of a rational approximation of the upper normal tail (absolute error below 7.5e-8).
TAIL_P = 0.2316419
TAIL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cumulative(x: Column) -> Column:
    """P(Z <= x)."""
    t = 1 / (1 + TAIL_P * F.abs(x))
    tail = density(F.abs(x)) * t * _poly(t, TAIL_B[::-1])
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def quantile(p: Column) -> Column:
    """The x with P(Z <= x) = p; null outside (0, 1)."""
    low = F.sqrt(-2 * F.log(F.when(p <= 0.5, p).otherwise(1 - p)))
    tail = _poly(low, QUANTILE_C) / _poly(low, QUANTILE_D)
    q = p - 0.5
    middle = _poly(q * q, QUANTILE_A) * q / _poly(q * q, QUANTILE_B)
    return F.when((p <= 0) | (p >= 1), None).when(p < QUANTILE_TAIL, tail).when(p > 1 - QUANTILE_TAIL, -tail).otherwise(middle)


def sql_cumulative(x: str) -> str:
    """``cumulative`` in SQL."""
    t = f"(1 / (1 + {TAIL_P}::DOUBLE * abs({x})))"
    poly = f"{TAIL_B[4]}::DOUBLE"
    for b in TAIL_B[3::-1]:
        poly = f"({poly} * {t} + {b}::DOUBLE)"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_quantile(p: str) -> str:
    """``quantile`` in SQL."""

    def poly(x, cs):
        out = f"{float(cs[0])}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {x} + {float(c)}::DOUBLE)"
        return out

    low = f"sqrt(-2 * ln(CASE WHEN {p} <= 0.5 THEN {p} ELSE 1 - {p} END))"
    tail = f"({poly(low, QUANTILE_C)} / {poly(low, QUANTILE_D)})"
    q = f"({p} - 0.5::DOUBLE)"
    middle = f"({poly(f'({q} * {q})', QUANTILE_A)} * {q} / {poly(f'({q} * {q})', QUANTILE_B)})"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {QUANTILE_TAIL} THEN {tail} WHEN {p} > {1 - QUANTILE_TAIL} THEN -{tail} ELSE {middle} END)"
