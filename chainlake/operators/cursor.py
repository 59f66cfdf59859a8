"""Ordered access as relational operators. Keys are one or two columns; rows are unique by key."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import BLOCKS_PER_BUCKET
from .filters import key_at_least, key_at_most, value


def scan(df: DataFrame, *keys: str) -> DataFrame:
    """All rows in key order."""
    return df.orderBy(*keys)


def scan_from(df: DataFrame, keys: Sequence[str], bound: Sequence[Any]) -> DataFrame:
    """Rows from the bound on, crossing into later first keys."""
    return df.where(key_at_least(keys, bound)).orderBy(*keys)


def first(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(1)


def last(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*(F.desc(k) for k in keys)).limit(1)


def lower_bound(df: DataFrame, keys: Sequence[str], bound: Sequence[Any]) -> DataFrame:
    """The first row at or after the bound; for two keys it may lie in a later first key."""
    return scan_from(df, keys, bound).limit(1)


def next_k1(df: DataFrame, k1: str, k2: str, at: Any) -> DataFrame:
    """The first row of the next first key."""
    return df.where(F.col(k1) > value(at)).orderBy(k1, k2).limit(1)


def previous_k1(df: DataFrame, k1: str, k2: str, at: Any) -> DataFrame:
    """The last row of the first key before."""
    return df.where(F.col(k1) < value(at)).orderBy(F.desc(k1), F.desc(k2)).limit(1)


def within_k1(df: DataFrame, k1: str, k2: str, at: Any) -> DataFrame:
    """All rows of one first key, in order."""
    return df.where(F.col(k1) == value(at)).orderBy(k2)


def last_of_k1(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """The last row of every first key: one aggregation, whatever the group sizes."""
    rest = [c for c in df.columns if c != k1]
    ordered = F.struct(k2, *(c for c in rest if c != k2))
    return df.groupBy(k1).agg(F.max_by(ordered, k2).alias("r")).select(k1, "r.*")


def ordered_bucket(df: DataFrame, key: str) -> Column:
    """A coarse value of a key that never decreases along it: a run of numbers, or the first two bytes or characters."""
    if isinstance(df.schema[key].dataType, T.NumericType):
        return F.floor(F.col(key) / BLOCKS_PER_BUCKET)
    return F.substring(key, 1, 2)


def neighbours(df: DataFrame, k2: str, k1: str | None = None) -> DataFrame:
    """Adds previous_key and next_key, within the first key if there is one.

    Without a first key the windows run inside buckets of the key; a bucket's ends are found among the
    buckets' own first and last keys, a row a bucket, so no task sees the whole table.
    """
    if k1:
        w = Window.partitionBy(k1).orderBy(k2)
        return df.withColumn("previous_key", F.lag(k2).over(w)).withColumn("next_key", F.lead(k2).over(w))
    placed = df.withColumn("nb_bucket", ordered_bucket(df, k2))
    w, along = Window.partitionBy("nb_bucket").orderBy(k2), Window.orderBy("nb_bucket")
    ends = placed.groupBy("nb_bucket").agg(F.min(k2).alias("nb_first"), F.max(k2).alias("nb_last"))
    ends = ends.select("nb_bucket", F.lag("nb_last").over(along).alias("nb_before"), F.lead("nb_first").over(along).alias("nb_after"))
    inside = placed.withColumn("previous_key", F.lag(k2).over(w)).withColumn("next_key", F.lead(k2).over(w))
    both = inside.join(ends, "nb_bucket")
    return both.select(*df.columns, F.coalesce("previous_key", "nb_before").alias("previous_key"), F.coalesce("next_key", "nb_after").alias("next_key"))


def items(df: DataFrame, k1: str, k2: str) -> DataFrame:
    """Rows in order, each marked whether it begins a new first key."""
    w = Window.partitionBy(k1).orderBy(k2)
    return df.withColumn("is_new_k1", F.row_number().over(w) == 1).orderBy(k1, k2)


def between(keys: Sequence[str], low: Sequence[Any], high: Sequence[Any], inclusive: bool = True) -> Column:
    upper = key_at_most(keys, high)
    if not inclusive:
        upper = upper & ~F.struct(*keys).eqNullSafe(F.struct(*(value(b).alias(k) for k, b in zip(keys, high, strict=True))))
    return key_at_least(keys, low) & upper


def delete_range(df: DataFrame, keys: Sequence[str], low: Sequence[Any], high: Sequence[Any], inclusive: bool = True) -> DataFrame:
    """What is left when low..high is deleted; high itself stays unless inclusive."""
    return df.where(~between(keys, low, high, inclusive))


def take_range(df: DataFrame, keys: Sequence[str], low: Sequence[Any], high: Sequence[Any]) -> tuple[DataFrame, DataFrame]:
    """(taken, kept) of low..high inclusive."""
    inside = between(keys, low, high)
    return df.where(inside).orderBy(*keys), df.where(~inside)


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def clear_k1(df: DataFrame, k1: str, at: Any) -> DataFrame:
    return df.where(F.col(k1) != value(at))


def get_many(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each wanted key, nulls for absent ones."""
    return wanted.join(df, list(keys), "left")


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with rows put over it by key. rows must be unique by key."""
    return df.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*df.columns))
