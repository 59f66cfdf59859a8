"""Predicates: log filters, key comparisons, and block ranges that also prune partitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCKS_PER_BUCKET


def value(v: Any) -> Column:
    return F.lit(bytearray(v)) if isinstance(v, bytes) else F.lit(v)


def matches(column: str, values: Sequence[Any]) -> Column | None:
    """Nothing for no values, equality for one, IN for more. Null columns never match."""
    if not values:
        return None
    return F.col(column) == value(values[0]) if len(values) == 1 else F.col(column).isin([value(v) for v in values])


def all_of(parts: Sequence[Column | None]) -> Column:
    found = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, found) if found else F.lit(True)


def block_range(df: DataFrame, first: int | None, last: int | None, column: str = "block_number") -> DataFrame:
    """Rows of blocks first..last, both inclusive, None being open; prunes block_bucket where df has it."""
    parts: list[Column | None] = []
    for bound, lower in ((first, True), (last, False)):
        if bound is None:
            continue
        parts.append(F.col(column) >= bound if lower else F.col(column) <= bound)
        if "block_bucket" in df.columns:
            bucket = bound // BLOCKS_PER_BUCKET
            parts.append(F.col("block_bucket") >= bucket if lower else F.col("block_bucket") <= bucket)
    return df.where(all_of(parts)) if parts else df


@dataclass(frozen=True)
class LogFilter:
    """AND across positions, OR within one, empty means any. at_hash names one block instead of a range."""

    from_block: int | None = None
    to_block: int | None = None
    address: tuple = ()
    topics: tuple[tuple, ...] = field(default=((), (), (), ()))
    at_hash: Any = None

    def predicate(self) -> Column:
        named = [("address", self.address), *((f"topic{i}", t) for i, t in enumerate(self.topics))]
        return all_of([matches(c, v) for c, v in named])


def key_at_least(keys: Sequence[str], bound: Sequence[Any]) -> Column:
    """(k1, k2, ...) >= bound in lexicographic order, the first key also alone so that it is pushed down."""
    whole = F.struct(*keys) >= F.struct(*(value(b).alias(k) for k, b in zip(keys, bound, strict=True)))
    return (F.col(keys[0]) >= value(bound[0])) & whole


def key_at_most(keys: Sequence[str], bound: Sequence[Any]) -> Column:
    whole = F.struct(*keys) <= F.struct(*(value(b).alias(k) for k, b in zip(keys, bound, strict=True)))
    return (F.col(keys[0]) <= value(bound[0])) & whole
