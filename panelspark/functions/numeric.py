"""Numeric expressions: decimal rounding of binary values, bounds, logistic and information measures."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054  # fixed value: 97.5 % point of the normal distribution


def js_round(value: Column, digits: int) -> Column:
    """The double rounded on its exact binary value, exact ties away from zero; null if not finite, and never -0.0."""
    unit = 10.0**-digits
    half = unit / 2
    if Fraction(half) < Fraction(1, 2 * 10**digits):  # the least double at or above the exact half
        half = math.nextafter(half, math.inf)
    doubled = value * float(2 ** (digits + 1))
    tie = (doubled == F.floor(doubled)) & (F.pmod(doubled, F.lit(2.0)) == 1)
    shown = F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")
    small = F.when(F.abs(value) >= half, F.signum(value) * unit).otherwise(0.0)
    rounded = F.when(F.abs(value) < unit, small).when(tie, F.round(value, digits)).otherwise(shown)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, rounded + 0.0)


def r6(value: Column, digits: int = 6) -> Column:
    """Plain rounding for results that are compared across engines; -0.0 becomes 0.0."""
    return F.round(value, digits) + 0.0


def share(part: Column, whole: Column) -> Column:
    """part / whole, null over nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def choose2(n: Column) -> Column:
    return F.when(n < 2, 0).otherwise(n * (n - 1) / 2).cast("double")


def sigmoid(x: Column) -> Column:
    """Stable on either side of zero."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def entropy(values: Column) -> Column:
    return -F.aggregate(values, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log(F.when(p > 0, p))).otherwise(0.0))


def wilson_lower(wins: Column, total: Column) -> Column:
    """Lower 95 % Wilson bound of wins / total; null without trials."""
    n = total.cast("double")
    p = share(wins, total)
    z2 = Z95 * Z95
    return F.when(total > 0, (p + z2 / (2 * n) - Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))


def median(values: Column) -> Column:
    """Exact median of an array, the mean of the middle two if even."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def choice_probabilities(mu: Column, a: Column, b: Column, tie: float | Column = 0.2, temperature: float = 0.35) -> tuple[Column, Column, Column]:
    """Chances that A, B or neither is preferred by someone whose ideal is mu."""
    gain = F.abs(mu - b) - F.abs(mu - a)
    p_a = 1 / (1 + F.exp(-(gain - tie) / temperature))
    p_b = 1 / (1 + F.exp(-(-gain - tie) / temperature))
    return p_a, p_b, F.greatest(F.lit(1e-12), 1 - p_a - p_b)


def register(spark) -> None:
    """SQL names for the expressions that are useful in ad hoc queries."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION wilson_lower(w DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN (w / n + {Z95 * Z95} / (2 * n) - {Z95} * sqrt((w / n * (1 - w / n) + {Z95 * Z95} / (4 * n)) / n)) / (1 + {Z95 * Z95} / n) END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION logistic(x DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-x))")
