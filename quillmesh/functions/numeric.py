"""Numbers: coercion, guarded ratios, vectors as arrays, the normal tail."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Chebyshev coefficients of a common fit of ln(erfc) (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def to_number(c: Column, kind: str = "double") -> Column:
    """Null for what is no number."""
    return c.try_cast(kind)


def to_count(c: Column) -> Column:
    """An integer, 0 for what is no number."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("int")


def fold_change(value: Column, control_mean: Column) -> Column:
    """value / control_mean; null where the mean isn't positive."""
    return F.when(control_mean > 0, F.try_divide(value, control_mean))


def log2_ratio(a: Column, b: Column) -> Column:
    """log2(a / b); null where b is 0, minus infinity where a is 0."""
    r = F.try_divide(a, b)
    return F.when(r == 0, F.lit(float("-inf"))).otherwise(F.log2(F.when(r > 0, r)))


def neg_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").otherwise("*")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), norm)


def pair_vector(a: Column, b: Column) -> Column:
    """a, b, |a - b| and a * b, one after the other."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def normal_tail(z: Column) -> Column:
    """P(Z >= |z|) from the fitted erfc, inside generated code."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.lit(0.5) * t * F.exp(-x * x + poly)


def _tails(z: pa.Array) -> pa.Array:
    return pa.array([None if v is None else 0.5 * math.erfc(abs(v) / math.sqrt(2)) for v in z.to_pylist()], pa.float64())


def normal_tail_exact(z: Column) -> Column:
    """P(Z >= |z|) to full precision, in Arrow batches."""
    return F.arrow_udf(_tails, "double")(z)


def kolmogorov_tail(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sided p-value of a two-sample Kolmogorov-Smirnov distance."""
    en = n.cast("double") * m / (n + m)
    x2 = d * d * en
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * x2))
    # at distances this small the series needs more terms and its value is 1
    return F.when(x2 < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series)))


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def signed(c: Column, digits: int = 1) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), F.format_number(c, digits))
