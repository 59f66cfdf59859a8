"""The history index: by key the blocks that changed it, in shards. Derived from the change tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import BLOCKS_PER_BUCKET, OPEN_SHARD, SHARD_CAP
from .filters import block_range


def changed(changes: DataFrame, keys: Sequence[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """By key the sorted distinct blocks in first..last that changed it."""
    return block_range(changes, first, last).groupBy(*keys).agg(F.sort_array(F.collect_set("block_number")).alias("blocks"))


def shards(changes: DataFrame, keys: Sequence[str], cap: int = SHARD_CAP) -> DataFrame:
    """(keys, highest, is_open, blocks): runs of cap blocks keyed by their highest, the last one open.

    A key that most blocks change is no task of its own: places are counted within (key, block bucket),
    and the buckets' counts, one row each, are added up before. A shard is gathered by (key, number),
    so no group exceeds cap.
    """
    seen = changes.select(*keys, F.floor(F.col("block_number") / BLOCKS_PER_BUCKET).alias("bucket"), "block_number").distinct()
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("block_number"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = seen.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = seen.withColumn("inside", inside).join(before, [*keys, "bucket"])
    numbered = placed.withColumn("shard", F.floor((F.col("inside") - 1 + F.col("before")) / cap)).select(*keys, "block_number", "shard")
    made = numbered.groupBy(*keys, "shard").agg(F.sort_array(F.collect_list("block_number")).alias("blocks"), F.max("block_number").alias("highest"))
    last = Window.partitionBy(*keys).orderBy("shard")
    is_open = F.lead("shard").over(last).isNull()
    return made.withColumn("is_open", is_open).select(*keys, F.when(F.col("is_open"), F.lit(OPEN_SHARD)).otherwise(F.col("highest")).alias("highest"), "is_open", "blocks")


def append(history: DataFrame, changes: DataFrame, keys: Sequence[str], first: int, last: int, cap: int = SHARD_CAP) -> DataFrame:
    """history with the changes of first..last added: only the open shards of touched keys change.

    Blocks that don't exceed those already indexed raise. Open shards meet their new blocks in one join.
    """
    new = changed(changes, keys, first, last).withColumnRenamed("blocks", "more")
    opened = history.where("is_open").select(*keys, "blocks").join(new, list(keys), "full")
    old = F.coalesce("blocks", F.array().cast("array<bigint>"))
    ok = F.coalesce(F.element_at(F.when(F.size(old) > 0, old), -1) < F.col("more")[0], F.lit(True))
    joined = F.when(ok, F.concat(old, "more")).otherwise(F.raise_error(F.lit("history blocks must ascend")).cast("array<bigint>"))
    whole = opened.select(*keys, F.coalesce(F.when(F.col("more").isNotNull(), joined), "blocks").alias("all"), F.col("more").isNull().alias("same"))
    n = F.when(F.col("same"), F.lit(1)).otherwise(F.ceil(F.size("all") / cap).cast("int"))
    pieces = F.when(F.col("same"), F.array("all")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col("all"), i * cap + 1, cap)))
    cut = whole.select(*keys, n.alias("n"), F.posexplode(pieces).alias("i", "blocks"))
    is_open = F.col("i") == F.col("n") - 1
    made = cut.select(*keys, F.when(is_open, F.lit(OPEN_SHARD)).otherwise(F.element_at("blocks", -1)).alias("highest"), is_open.alias("is_open"), "blocks")
    return history.where(~F.col("is_open")).select(*made.columns).unionByName(made)


def trim(history: DataFrame, keys: Sequence[str], above: int) -> DataFrame:
    """history without blocks above the given one; the last shard left of each key becomes the open one."""
    cut = history.withColumn("blocks", F.filter("blocks", lambda b: b <= above)).where(F.size("blocks") > 0)
    w = Window.partitionBy(*keys).orderBy("highest")
    is_open = F.lead("highest").over(w).isNull()
    cut = cut.withColumn("is_open", is_open)
    return cut.withColumn("highest", F.when(F.col("is_open"), F.lit(OPEN_SHARD)).otherwise(F.element_at("blocks", -1)))


def last_shard(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    return history.groupBy(*keys).agg(F.max_by(F.struct("highest", "is_open", "blocks"), "highest").alias("s")).select(*keys, "s.*")
