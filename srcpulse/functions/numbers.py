"""Rounding, and naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two halves of 26 bits


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Round to ``digits`` decimals by the exact binary value of the double, ties to even.

    ``round`` and ``bround`` work on the shortest decimal text, so they move 2.675 (whose binary value
    is below the tie) up. Here the distance to the tie is computed without error: the value is split into
    two halves whose products with a small integer are exact. Valid for ``abs(x) < 2**40``.
    """
    scale = 10.0**digits

    def rounded(v: Column) -> Column:
        low = F.floor(v * scale).cast("double")
        carry = v * _SPLITTER
        high = carry - (carry - v)
        side = (high * (2 * scale) - (low * 2 + 1)) + (v - high) * (2 * scale)
        up = bind(side, lambda s: (s > 0) | ((s == 0) & (low % 2 != 0)))
        return (low + up.cast("double")) / scale

    return bind(x, rounded)
