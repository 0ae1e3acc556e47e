"""Checked arithmetic, sign-safe comparison and membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(20,0)"


def mul_checked(a: Column, b: Column) -> Column:
    """Product of longs, null if it overflows."""
    return F.try_multiply(a.cast("long"), b.cast("long"))


def add_checked(a: Column, b: Column) -> Column:
    return F.try_add(a.cast("long"), b.cast("long"))


def cmp_less(a: Column, b: Column) -> Column:
    """a < b by value, whichever of them is signed or unsigned."""
    return a.cast(_WIDE) < b.cast(_WIDE)


def cmp_greater(a: Column, b: Column) -> Column:
    return a.cast(_WIDE) > b.cast(_WIDE)


def cmp_greater_equal(a: Column, b: Column) -> Column:
    return a.cast(_WIDE) >= b.cast(_WIDE)


def contains(items: Column, value: Column) -> Column:
    return F.array_contains(items, value)


def index_of(items: Column, value: Column) -> Column:
    """First position from 0, or null."""
    at = F.array_position(items, value)
    return F.when(at > 0, at - 1)


def code_in(value: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out
