"""Rational times (value, scale) as column expressions, always reduced, so that equal times are equal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's rule: a step at most for each 0.69 bits of the smaller number, which are all that are taken."""
    a, b = F.abs(a).cast("long"), F.abs(b).cast("long")
    steps = F.ceil(F.log2(F.least(a, b) + 1) * 1.4405).cast("int") + 2
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple, 0 if one is 0; null beyond 64 bits."""
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), 0).otherwise(F.try_multiply(F.abs(_div(a.cast("long"), F.when(g == 0, 1).otherwise(g))), F.abs(b).cast("long")))


def _div(a: Column, b: Column) -> Column:
    """Whole division, truncated toward zero."""
    return F.call_function("div", a, b)


def reduced(value: Column, scale: Column) -> Column:
    """struct(value, scale) in lowest terms; null where the scale is 0, which stands for no time."""
    value, scale = value.cast("long"), scale.cast("long")
    both = F.transform(F.array(gcd(value, scale)), lambda g: F.struct(_div(value, g).alias("value"), _div(scale, g).alias("scale")))
    return F.when((scale != 0) & value.isNotNull(), F.get(both, F.lit(0)))


def add(a: Column, a_scale: Column, b: Column, b_scale: Column) -> Column:
    """The sum in lowest terms; null where a scale is 0 or a number on the way passes 64 bits."""
    value = F.try_add(F.try_multiply(a, b_scale), F.try_multiply(b, a_scale))
    return reduced(value, F.try_multiply(a_scale, b_scale))


def subtract(a: Column, a_scale: Column, b: Column, b_scale: Column) -> Column:
    return add(a, a_scale, -b, b_scale)


def microseconds(value: Column, scale: Column) -> Column:
    """Truncated toward zero; the product is taken in decimal, as it may pass 64 bits."""
    wide = value.cast("decimal(38,0)") * F.lit(1_000_000)
    return F.when(scale != 0, _div(wide, scale.cast("decimal(38,0)")).cast("long"))
