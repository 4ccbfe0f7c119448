"""Rounding that gives the same values in both engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


NUDGE = 1e-10


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, no negative zero. What lies half-way between two is moved up first: sums in another
    order differ in their last digit, which then decides nothing."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)).alias(name or column)


def s6(column: str, name: str | None = None) -> str:
    return f"{x6(column)} AS {name or column}"


def x6(value: str) -> str:
    return f"round(({value}) + {NUDGE}::DOUBLE, 6) + 0.0"
