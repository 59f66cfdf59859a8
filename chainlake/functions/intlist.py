"""Sorted lists of block numbers as ARRAY<BIGINT>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsortedInput


def new(values: Sequence[int]) -> list[int]:
    """A strictly ascending list, or UnsortedInput."""
    out = list(values)
    if any(a >= b for a, b in zip(out, out[1:], strict=False)):
        raise UnsortedInput("values must ascend strictly")
    return out


def append(values: Sequence[int], more: Sequence[int]) -> list[int]:
    """values followed by more; both must ascend, and so must the whole."""
    return new([*values, *more])


def is_sorted(c: Column | str) -> Column:
    """Whether a list ascends strictly (an empty one does)."""
    c = F.col(c) if isinstance(c, str) else c
    return c == F.array_sort(F.array_distinct(c))


def checked_append(c: Column, more: Column) -> Column:
    """The joined list; raises unless it ascends strictly."""
    both = F.concat(c, more)
    return F.when(is_sorted(both), both).otherwise(F.raise_error(F.lit("values must ascend strictly")))


def rank(c: Column | str, x: Column | int) -> Column:
    """How many values are <= x."""
    x = F.lit(x) if isinstance(x, int) else x
    return F.size(F.filter(c, lambda e: e <= x)).cast("long")


def select(c: Column | str, n: Column | int) -> Column:
    """The n-th value, from 0; null beyond the end."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.try_element_at(F.col(c) if isinstance(c, str) else c, (n + 1).cast("int"))


def contains(c: Column | str, x: int) -> Column:
    return F.array_contains(c, x)


def smallest(c: Column | str) -> Column:
    return F.array_min(c)


def largest(c: Column | str) -> Column:
    return F.array_max(c)


def length(c: Column | str) -> Column:
    return F.size(c).cast("long")
