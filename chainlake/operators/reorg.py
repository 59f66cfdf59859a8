"""Rolling back: truncation, draining, state unwinding, and the comparison of two tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import first_after
from .filters import block_range
from .reads import Tables, part, with_logs


def truncate(t: Mapping[str, DataFrame], above: int) -> dict[str, DataFrame]:
    """Every table without the blocks above."""
    return {name: block_range(df, None, above) for name, df in t.items()}


def undone(changes: DataFrame, keys: Sequence[str], values: Sequence[str], above: int) -> DataFrame:
    """The keys that changed above, each with the value that it goes back to: the pre-image of its first change."""
    found = first_after(changes, keys, [f"pre_{v}" for v in values], above)
    return found.select(*keys, *(F.col(f"pre.pre_{v}").alias(v) for v in values))


def unwind(current: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], above: int, is_empty: Column) -> DataFrame:
    """The state after undoing all changes above.

    is_empty, over the value columns, tells which restored rows are deleted.
    """
    back = undone(changes, keys, values, above)
    untouched = current.select(*keys, *values).join(back.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(back.where(~F.coalesce(is_empty, F.lit(True))))


def drain(t: Tables, above: int) -> DataFrame:
    """(block_number, receipts) of every stored block above, ascending; receipts in order with their logs.

    Blocks without receipts have an empty list. Truncate in the same commit.
    """
    headers = part(t, "headers", above + 1, None)
    full = with_logs(part(t, "receipts", above + 1, None), part(t, "logs", above + 1, None))
    rest = [c for c in full.columns if c not in ("block_number", "tx_index", "block_bucket")]
    one = F.struct("tx_index", *rest)
    kind = f"array<{full.select(one.alias('x')).schema['x'].dataType.simpleString()}>"
    listed = full.groupBy("block_number").agg(F.sort_array(F.collect_list(one)).alias("receipts"))
    out = headers.select("block_number").join(listed, "block_number", "left")
    return out.withColumn("receipts", F.coalesce("receipts", F.array().cast(kind))).orderBy("block_number")


def lag(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """first_missing: the first block that cold lacks by its tip; 0 if cold is empty and hot isn't, null if level."""
    h, c = (x.agg(F.max("block_number").alias(n)) for x, n in ((hot, "h"), (cold, "c")))
    missing = F.when(F.col("h").isNull(), None).when(F.col("c").isNull(), F.lit(0)).when(F.col("c") < F.col("h"), F.col("c") + 1)
    return h.crossJoin(c).select(missing.cast("long").alias("first_missing"))  # one row each


def gaps(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Blocks of hot that cold lacks, and of cold that hot lacks: what comparing tips can't see."""
    h, c = hot.select("block_number", F.lit(True).alias("in_hot")), cold.select("block_number", F.lit(True).alias("in_cold"))
    both = h.join(c, "block_number", "full")
    f = F.lit(False)
    return both.select("block_number", F.coalesce("in_hot", f).alias("in_hot"), F.coalesce("in_cold", f).alias("in_cold")).where("NOT (in_hot AND in_cold)").orderBy("block_number")


def number_gaps(headers: DataFrame) -> DataFrame:
    """(gap_start, gap_end) of every stretch of missing numbers between stored blocks.

    Numbers are compared across range partitions of block numbers, so no task sees the whole table:
    the window runs inside a bucket, and the buckets' ends are compared among themselves.
    """
    bucket = F.floor(F.col("block_number") / 10_000)
    h = headers.select("block_number", bucket.alias("b"))
    w = Window.partitionBy("b").orderBy("block_number")
    inside = h.withColumn("before", F.lag("block_number").over(w)).where("before IS NOT NULL").select("before", "block_number")
    ends = h.groupBy("b").agg(F.min("block_number").alias("block_number"), F.max("block_number").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("b"))).where("before IS NOT NULL").select("before", "block_number")
    return inside.unionByName(across).where("block_number > before + 1").select((F.col("before") + 1).alias("gap_start"), (F.col("block_number") - 1).alias("gap_end"))


def breaks(headers: DataFrame) -> DataFrame:
    """Blocks that don't extend their predecessor: a number that isn't the next, or another parent hash.

    Each block is joined with the block before it by number, so the check is an equi-join, not a sort.
    The first block has nothing before it and isn't reported.
    """
    first = headers.agg(F.min("block_number").alias("first_block"))
    parent = headers.select((F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("expected_parent"))
    linked = headers.select("block_number", "parent_hash").join(parent, "block_number", "left").crossJoin(F.broadcast(first))  # one row
    kind = F.when(F.col("expected_parent").isNull(), "gap").when(F.col("expected_parent") != F.col("parent_hash"), "parent")
    return linked.where("block_number > first_block").withColumn("kind", kind).where("kind IS NOT NULL").select("block_number", "kind")


def level(hot_blocks: DataFrame, cold: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows to replay: those of blocks that hot has and cold's headers lack."""
    missing = hot_blocks.select("block_number").join(cold["headers"].select("block_number"), "block_number", "left_anti")
    return {name: df.join(missing, "block_number", "left_semi") for name, df in cold.items()}
