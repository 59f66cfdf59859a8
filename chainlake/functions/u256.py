"""256-bit unsigned numbers as 32 big-endian bytes. Their binary order is their numeric order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

ZERO = bytes(32)
MAX = (1 << 256) - 1


def encode(n: int, size: int = 32) -> bytes:
    if not 0 <= n < 1 << (8 * size):
        raise SchemaError(f"{n} doesn't fit {size} bytes")
    return n.to_bytes(size, "big")


def decode(b: bytes | bytearray) -> int:
    return int.from_bytes(b, "big")


def lit(n: int, size: int = 32) -> Column:
    return F.lit(bytearray(encode(n, size)))


def of_long(c: Column | str, size: int = 32) -> Column:
    """A non-negative BIGINT as big-endian bytes."""
    return F.lpad(F.unhex(F.hex(F.col(c) if isinstance(c, str) else c)), size, F.lit(bytearray(1)))


def to_decimal(c: Column | str) -> Column:
    """The number as DECIMAL(38, 0); null beyond 16 bytes or 10^38 - 1."""
    c = F.col(c) if isinstance(c, str) else c
    h = F.hex(c)
    small = F.substring(h, 1, 32) == "0" * 32
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("decimal(38,0)")
    wide = F.lit(1 << 32).cast("decimal(38,0)")
    # limbs of 32 bits; the first two must be small for the sum to fit
    high = part(33) * wide + part(41)
    fits = F.conv(F.substring(h, 33, 16), 16, 10).cast("decimal(20,0)") < F.lit(5421010862427522170).cast("decimal(20,0)")
    low = part(49) * wide + part(57)
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    return F.when(small & fits, (high.cast("decimal(18,0)") * two64.cast("decimal(20,0)")).cast("decimal(38,0)") + low)


def limbs(c: str) -> list[Column]:
    """Four 64-bit limbs as DECIMAL(20, 0), highest first."""
    return [F.conv(F.substring(F.hex(c), 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]


def sums(df: DataFrame, keys: list[str], value: str, out: str = "total") -> DataFrame:
    """Exact sum of value by keys, modulo nothing: a total beyond 256 bits raises.

    The limbs are summed apart, with partial sums, so the shuffle has a row a key and task.
    """
    parts = [f"{out}_{i}" for i in range(4)]
    summed = df.select(*keys, *(c.alias(p) for c, p in zip(limbs(value), parts, strict=True))).groupBy(*keys).agg(*(F.sum(p).alias(p) for p in parts))
    return summed.withColumn(out, _carry(*parts)).drop(*parts)


@F.pandas_udf(T.BinaryType())
def _carry(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else encode((int(w) << 192) + (int(x) << 128) + (int(y) << 64) + int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)])


@F.pandas_udf(T.BinaryType())
def add(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sum of two numbers; raises beyond 256 bits, null if either is."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else encode(decode(x) + decode(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.BinaryType())
def subtract(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Difference of two numbers; raises below 0, null if either is."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else encode(decode(x) - decode(y)) for x, y in zip(a, b, strict=True)])
