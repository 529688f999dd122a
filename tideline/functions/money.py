"""Whole-cent money arithmetic as column expressions. Money is BIGINT cents, never DOUBLE."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

FLOOR, CEIL, HALF_UP = "floor", "ceil", "half_up"
WIDE = "decimal(38,0)"


def div_round(numerator: Column, denominator: Column, mode: str = FLOOR, positive: bool = False) -> Column:
    """Integer division with the named rounding; a zero denominator is an error.

    ``positive`` states that the denominator is above zero, which keeps the expression short.
    """
    if positive:
        n, d = numerator, denominator
    else:
        n, d = F.when(denominator < 0, -numerator).otherwise(numerator), F.abs(denominator)
    if mode == FLOOR:
        return _div(n - F.pmod(n, d), d)
    if mode == CEIL:
        return _div(n + F.pmod(-n, d), d)
    if mode == HALF_UP:
        return F.when(n >= 0, _div(n * 2 + d, d * 2)).otherwise(-_div(d - n * 2, d * 2))
    raise ValueError(f"unknown rounding mode {mode!r}")


def _div(n: Column, d: Column) -> Column:
    return F.call_function("div", n, d)


def mul_div(value: Column, mul: int, div: int, mode: str, negative: bool = True) -> Column:
    """value × mul ÷ div, rounded once, on BIGINT.

    The fraction is reduced first, which leaves room for any real amount; a product that did not
    fit would raise under ANSI arithmetic instead of wrapping. ``negative=False`` states that the
    value is never below zero: then a plain integer division rounds down.
    """
    g = math.gcd(mul, div)
    n, d = value.cast("bigint") * F.lit(mul // g).cast("bigint"), F.lit(div // g).cast("bigint")
    if negative:
        return div_round(n, d, mode, positive=True)
    above = {FLOOR: 0, CEIL: div // g - 1, HALF_UP: div // g}[mode]
    if mode == HALF_UP:
        return _div(n * 2 + F.lit(above).cast("bigint"), d * 2)
    return _div(n + F.lit(above).cast("bigint") if above else n, d)


def ratio6(a: Column, b: Column) -> Column:
    """a ÷ b kept to six places, rounded half away from zero on integers."""
    scaled = div_round((a.cast(WIDE) * F.lit(1_000_000)).cast(WIDE), b.cast(WIDE), HALF_UP)
    return scaled.cast("double") / 1_000_000.0


def to_cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")
