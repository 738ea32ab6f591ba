"""Exact integer time arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Euclid on two values below 2^63 ends within 92 steps, below 2^32 within 47.
_STEPS_64 = 92


def gcd(a: Column, b: Column, steps: int = _STEPS_64) -> Column:
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))

    def step(acc, _):
        return F.when(acc["y"] == 0, acc).otherwise(
            F.struct(acc["y"].alias("x"), (acc["x"] % F.nullif(acc["y"], F.lit(0).cast("long"))).alias("y"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["x"])


def array_gcd(values: Column, steps: int = 47) -> Column:
    """gcd of an array of counts; 0 for an empty array."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: gcd(acc, v, steps))


def reduce_fraction(num: Column, den: Column) -> Column:
    """num/den in lowest terms, NULL when either is zero."""
    g = gcd(num, den)
    return F.when((num != 0) & (den != 0), F.struct(int_div(num, g).alias("num"), int_div(den, g).alias("den")))


def int_div(a: Column, b: Column) -> Column:
    """Truncating division, NULL on a zero divisor."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def ceil_div(a: Column, b: Column) -> Column:
    """Ceiling division of non-negative values."""
    return int_div(a.cast("long") + b.cast("long") - 1, b)


def parse_rate(text: Column) -> Column:
    """'n/d' to (num, den); NULL when malformed or when either part is zero."""
    num = F.regexp_extract(text, r"^\+?(\d{1,10})/\+?(\d{1,10})$", 1)
    den = F.regexp_extract(text, r"^\+?(\d{1,10})/\+?(\d{1,10})$", 2)
    n, d = num.try_cast("long"), den.try_cast("long")
    top = (1 << 32) - 1
    return F.when((n > 0) & (d > 0) & (n <= top) & (d <= top), F.struct(n.alias("num"), d.alias("den")))
