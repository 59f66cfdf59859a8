"""State at a height: the pre-image of the first change after it, else the current value.

A change at height H is visible at H. Rows of change tables hold what was before (pre columns).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BLOCKS_PER_BUCKET
from .filters import block_range


def first_after(changes: DataFrame, keys: Sequence[str], pre: Sequence[str], height: int | None) -> DataFrame:
    """By key the pre columns, in a struct `pre`, of the first change above height. Partial sums keep hot keys small."""
    later = block_range(changes, None if height is None else height + 1, None)
    return later.groupBy(*keys).agg(F.min_by(F.struct(*pre), "block_number").alias("pre"))


def state_at(current: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], height: int | None) -> DataFrame:
    """The state of every key at height; None is the current state.

    changes has pre_<value> for each value. A key whose first change after height created it shows its
    pre-image as recorded (a default or null); `existed` passes through if changes has it.
    """
    if height is None:
        return current
    pre = [f"pre_{v}" for v in values]
    found = first_after(changes, keys, pre, height)
    both = current.select(*keys, F.struct(*values).alias("now")).join(found, list(keys), "full")
    pick = [F.when(F.col("pre").isNotNull(), F.col(f"pre.pre_{v}")).otherwise(F.col(f"now.{v}")).alias(v) for v in values]
    return both.select(*keys, *pick)


def bucket(column: str) -> Column:
    return F.floor(F.col(column) / BLOCKS_PER_BUCKET).alias("bucket")


def with_previous(changes: DataFrame, keys: Sequence[str], out: str, value: str = "block_number", last: str | None = None, together: bool = False) -> DataFrame:
    """Adds what value was in the key's row before; null for its first (and where value was null).

    Found within (key, block bucket), or from the bucket before with any change: windows hold a bucket
    of one key, or a row a bucket, so a key that changes in every block is spread over tasks. last names
    a column that tells a key's last row. together says that no key has rows in more blocks than a bucket
    has, so that one window of them is no larger: then nothing is joined.
    """
    whole = Window.partitionBy(*keys)
    if together:
        w = whole.orderBy("block_number")
        found = changes.withColumn(out, F.lag(value).over(w))
        return found.withColumn(last, F.lead("block_number").over(w).isNull()) if last else found
    placed = changes.select("*", bucket("block_number"))
    w = Window.partitionBy(*keys, "bucket").orderBy("block_number")
    ends = placed.groupBy(*keys, "bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), "block_number").alias("end"))
    ends = ends.select(*keys, "bucket", F.lag("end").over(whole.orderBy("bucket")).alias("end"), F.lead("bucket").over(whole.orderBy("bucket")).isNull().alias("final"))
    found = placed.withColumn("inside", F.lag(F.struct(F.col(value).alias("v"))).over(w)).withColumn("ends", F.lead("block_number").over(w).isNull()).join(ends, [*keys, "bucket"])
    made = found.withColumn(out, F.coalesce("inside", "end")["v"])
    return made.withColumn(last, F.col("ends") & F.col("final")).select(*changes.columns, out, last) if last else made.select(*changes.columns, out)


def intervals(current: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every value a key ever had, with valid_from (null: always) and valid_to, exclusive (null: still)."""
    was = with_previous(changes, keys, "valid_from").select(*keys, "valid_from", F.col("block_number").alias("valid_to"), *(F.col(f"pre_{v}").alias(v) for v in values))
    last = changes.groupBy(*keys).agg(F.max("block_number").alias("valid_from"))
    now = current.join(last, list(keys), "left").select(*keys, "valid_from", F.lit(None).cast("long").alias("valid_to"), *values)
    return was.unionByName(now)


def batch_state_at(requests: DataFrame, current: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """requests (keys and height) with the values at their heights; unknown keys give nulls.

    Requests and the changes of a key are sorted together, bucket by bucket of blocks, and each request
    takes the pre-image of the first change after it, or else what the next bucket with a change begins
    with, or else the current value. No pair of request and change is ever made, and no window holds
    more than a bucket of one key.
    """
    pre = [F.col(f"pre_{v}").alias(v) for v in values]
    now = current.select(*keys, F.lit(1 << 62).alias("at"), F.lit(1).alias("is_bound"), F.struct(*values).alias("v"))
    marks = changes.select(*keys, F.col("block_number").alias("at"), F.lit(1).alias("is_bound"), F.struct(*pre).alias("v")).unionByName(now)
    asked = requests.select(*keys, F.col("height").alias("at"), F.lit(0).alias("is_bound")).withColumn("v", F.lit(None).cast(marks.schema["v"].dataType))
    placed = marks.unionByName(asked).select("*", bucket("at"))
    # a change at height H is visible at H: it comes before the requests at H
    w = Window.partitionBy(*keys, "bucket").orderBy("at", F.desc("is_bound")).rowsBetween(1, Window.unboundedFollowing)
    bound = F.when(F.col("is_bound") == 1, F.struct("v"))
    found = placed.withColumn("hit", F.first(bound, ignorenulls=True).over(w))
    firsts = placed.groupBy(*keys, "bucket").agg(F.min_by(bound, F.when(F.col("is_bound") == 1, F.col("at"))).alias("first"))
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    later = firsts.select(*keys, "bucket", F.first("first", ignorenulls=True).over(ahead).alias("later"))
    asked = found.where("is_bound = 0").join(later, [*keys, "bucket"])
    hit = F.coalesce("hit", "later")
    return asked.withColumn("hit", hit).select(*keys, F.col("at").alias("height"), *(F.col(f"hit.v.{v}").alias(v) for v in values))


def evm_view(accounts: DataFrame, codes: DataFrame) -> DataFrame:
    """Accounts with their code; an account without code, or with unknown code, has an empty one."""
    empty = F.lit(bytearray())
    return accounts.join(codes.withColumnRenamed("code_hash", "bytecode_hash"), "bytecode_hash", "left").withColumn("code", F.coalesce("code", empty))
