"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_single(x: Column) -> Column:
    """A number rounded to single precision, as a double."""
    return x.cast("float").cast("double")


def bin_of(x: Column, edges: list[float], compiled: bool = False) -> Column:
    """Edges strictly below ``x``, both in single precision. Missing values, null or NaN, come after every number.

    ``compiled`` searches ascending edges by nested conditions, which Spark compiles; other edges are counted.
    """
    number = F.coalesce(x.cast("float"), F.lit(float("nan")).cast("float"))
    if compiled and all(a <= b for a, b in zip(edges, edges[1:])):
        def among(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo).cast("tinyint")
            at = (lo + hi) // 2
            return F.when(F.lit(float(edges[at])).cast("float") < number, among(at + 1, hi)).otherwise(among(lo, at))

        return among(0, len(edges))
    held = F.array(*[F.lit(float(e)).cast("float") for e in edges]) if edges else F.array().cast("array<float>")
    return F.size(F.filter(held, lambda e: e < number)).cast("tinyint")


def gain(g: Column, n: Column, l2: float) -> Column:
    """Half of g^2 / (n + l2); zero where the denominator isn't positive."""
    below = n + F.lit(float(l2))
    return F.when(below > 0, 0.5 * g * g / below).otherwise(F.lit(0.0))


def newton(g: Column, n: Column, l2: float) -> Column:
    below = n + F.lit(float(l2))
    return F.when(below > 0, -g / below).otherwise(F.lit(0.0))


def correlation(x: Column, y: Column, floor: float = 1e-12) -> Column:
    """Pearson's correlation as an aggregate; null under two rows or where either hardly varies."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 2) & (sx > floor) & (sy > floor), F.covar_pop(x, y) / (sx * sy))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def signal(prediction: Column, multiplier: float) -> Column:
    """A position in [0, 2] from a prediction."""
    return clip(1.0 + F.lit(float(multiplier)) * prediction, 0.0, 2.0)


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), x)
