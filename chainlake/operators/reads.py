"""Lookups, ranges, joins and log queries over the chain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import HeightOutOfRange, NoBlocks, TooManyLogs
from .filters import LogFilter, block_range, value

Tables = Mapping[str, DataFrame]
#: Logs that are broadcast to transactions and receipts at most.
FEW = 100_000
CONFIRMED = ("block_number", "block_hash", "tx_index")


def by_key(df: DataFrame, **key: Any) -> DataFrame:
    """Rows with these key values: every point lookup."""
    for k, v in key.items():
        df = df.where(F.col(k) == value(v))
    return df


def part(t: Tables, name: str, first: int | None, last: int | None) -> DataFrame:
    """Blocks first..last of a table; a stored one opens only the files that can hold them."""
    return t.read(name, first, last) if hasattr(t, "read") else block_range(t[name], first, last)


def in_range(df: DataFrame, first: int | None, last: int | None, *order: str) -> DataFrame:
    """Rows of blocks first..last; sorted, which takes a shuffle, only if an order is asked for."""
    found = block_range(df, first, last)
    return found.orderBy(*order) if order else found


def block_of(rows: DataFrame) -> int:
    """The block of the one row that a hash names, -1 if there is none: what follows then reads that block only."""
    found = rows.select("block_number").first()
    return -1 if found is None else found[0]


def by_specs(df: DataFrame, specs: DataFrame, on: Sequence[str]) -> DataFrame:
    """A row for each row of specs (pos and the key columns), in order of pos; unknown keys give nulls.

    One join answers any number of lookups: prefer it over a job for each key.
    """
    keys = specs.select("pos", *(F.col(k).alias(f"spec_{k}") for k in on))
    match = [F.col(f"spec_{k}") == df[k] for k in on]
    return keys.join(df, match, "left").drop(*(f"spec_{k}" for k in on)).orderBy("pos")


# -- headers ----------------------------------------------------------------------------------


def tip(headers: DataFrame) -> DataFrame:
    """One row (block_number, block_hash) of the last block; nulls if there is none."""
    best = F.max(F.struct("block_number", "block_hash")).alias("tip")
    return headers.agg(best).select("tip.*")


def last_header(headers: DataFrame) -> DataFrame:
    return headers.agg(F.max_by(F.struct(*headers.columns), "block_number").alias("h")).select("h.*")


def first_header(headers: DataFrame) -> DataFrame:
    return headers.agg(F.min_by(F.struct(*headers.columns), "block_number").alias("h")).select("h.*")


def execution_range(headers: DataFrame) -> DataFrame:
    return headers.agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def latest_block(headers: DataFrame) -> DataFrame:
    return headers.agg(F.max("block_number").alias("latest_block"))


def has_block(headers: DataFrame, number: int) -> DataFrame:
    return by_key(headers, block_number=number).agg((F.count(F.lit(1)) > 0).alias("present"))


def check_height(headers: DataFrame, height: int | None) -> None:
    """Raises NoBlocks or HeightOutOfRange; None means the current state and always passes."""
    if height is None:
        return
    first, last = execution_range(headers).first()
    if first is None:
        raise NoBlocks("no blocks")
    if not first <= height <= last:
        raise HeightOutOfRange(height, first, last)


# -- transactions and receipts ----------------------------------------------------------------


def confirmed(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds the hash of each row's block; rows of unknown blocks drop out."""
    return rows.join(headers.select("block_number", "block_hash"), "block_number")


def transactions(t: Tables, **key: Any) -> DataFrame:
    """Transactions by tx_hash, by block_number and tx_index, or by block_hash and tx_index, with their block's hash.

    A hash is looked up first, so that the rows come from their block alone.
    """
    if "block_hash" in key:
        key["block_number"] = block_of(by_key(t["headers"], block_hash=key.pop("block_hash")))
    elif "tx_hash" in key and "block_number" not in key:
        key["block_number"] = block_of(by_key(t["transactions"], tx_hash=key["tx_hash"]))
    n = key.get("block_number")
    return confirmed(by_key(part(t, "transactions", n, n), **key), part(t, "headers", n, n))


def transactions_in_block(t: Tables, number: int) -> DataFrame:
    return part(t, "transactions", number, number).orderBy("tx_index")


def transaction_count(t: Tables, number: int) -> DataFrame:
    return part(t, "transactions", number, number).agg(F.count(F.lit(1)).alias("tx_count"))


def derive_receipts(receipts: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """Adds gas_used (cumulative less the one before) and first_log_index (logs before it in the block).

    receipts has cumulative_gas_used and, unless logs are given, n_logs. Decreasing gas raises.
    """
    if logs is not None:
        counts = logs.groupBy("block_number", "tx_index").agg(F.count(F.lit(1)).alias("n_logs"))
        receipts = receipts.join(counts, ["block_number", "tx_index"], "left").withColumn("n_logs", F.coalesce("n_logs", F.lit(0)))
    w = Window.partitionBy("block_number").orderBy("tx_index")
    before = F.coalesce(F.sum("n_logs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gas = F.col("cumulative_gas_used") - F.coalesce(F.lag("cumulative_gas_used").over(w), F.lit(0))
    out = receipts.withColumn("gas_used", gas).withColumn("first_log_index", before.cast("long"))
    return out.withColumn("gas_used", F.when(F.col("gas_used") < 0, F.raise_error(F.lit("cumulative gas decreases")).cast("long")).otherwise(F.col("gas_used")))


def receipts(t: Tables, **key: Any) -> DataFrame:
    """Receipts by tx_hash or by block_number and tx_index, with block hash and time and their logs in order.

    A hash is looked up first, so that headers and logs are read of one block alone.
    """
    if "block_number" not in key:
        key["block_number"] = block_of(by_key(t["receipts"], **key))
    n = key["block_number"]
    found = confirmed_with_time(by_key(part(t, "receipts", n, n), **key), part(t, "headers", n, n))
    return with_logs(found, part(t, "logs", n, n))


def confirmed_with_time(rows: DataFrame, headers: DataFrame) -> DataFrame:
    return rows.join(headers.select("block_number", "block_hash", "timestamp"), "block_number")


def with_logs(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Adds logs: array of structs in order of log_index, which counts through the block; none is an empty array.

    The logs are first reduced to the receipts asked for, then gathered: a group is one receipt.
    """
    keys = ["block_number", "tx_index"]
    mine = logs.join(rows.select(*keys, "first_log_index"), keys)
    rest = [c for c in logs.columns if c not in (*keys, "log_index", "block_bucket")]
    one = F.struct((F.col("first_log_index") + F.col("log_index")).alias("log_index"), *rest)
    kind = f"array<{mine.select(one.alias('x')).schema['x'].dataType.simpleString()}>"
    listed = mine.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("logs"))
    return rows.join(listed, keys, "left").withColumn("logs", F.coalesce("logs", F.array().cast(kind)))


def receipts_in_block(t: Tables, number: int) -> DataFrame:
    return receipts(t, block_number=number).orderBy("tx_index")


# -- bridge events and rollup headers ---------------------------------------------------------


def events_in_range(t: Tables, first: int, last: int) -> DataFrame:
    return part(t, "bridge_events", first, last)


def rollup_header(t: Tables, number: int) -> DataFrame:
    """A range asked of a single-header lookup gives the header at its start: pass that number."""
    return by_key(t["rollup_headers"], block_number=number)


def rollup_headers(t: Tables, first: int, last: int) -> DataFrame:
    return part(t, "rollup_headers", first, last)


# -- logs -------------------------------------------------------------------------------------


def placed(t: Tables, f: LogFilter) -> LogFilter:
    """f with a block hash looked up: a range of one block."""
    if f.at_hash is None:
        return f
    n = block_of(by_key(t["headers"], block_hash=f.at_hash))
    return replace(f, from_block=n, to_block=n, at_hash=None)


def matching(t: Tables, f: LogFilter) -> DataFrame:
    """The logs that match, as they are stored."""
    f = placed(t, f)
    return part(t, "logs", f.from_block, f.to_block).where(f.predicate())


def are_few(t: Tables, f: LogFilter) -> bool:
    """Whether so few logs match that they go to the transactions and receipts, instead of all rows to a shuffle. A count of stored logs."""
    return matching(t, f).count() <= FEW


def logs(t: Tables, f: LogFilter, limit: int | None = None, ordered: bool = False, few: bool = False) -> DataFrame:
    """Matching logs with block hash and time, transaction hash, and log_index counted through the block.

    An open end means the latest block; a block hash is looked up first and then is a range of one block.
    With a limit the plan takes limit + 1 rows at most, the first by (block, transaction, place); `checked`
    turns the extra one into an error. Without one the rows are sorted only if ordered is set. few says that
    FEW logs match at most: they are broadcast to what they are joined with.
    """
    f = placed(t, f)
    first, last = f.from_block, f.to_block
    mine = matching(t, f)
    keys = ["block_number", "tx_index"]
    txs = part(t, "transactions", first, last).select(*keys, "tx_hash")
    firsts = part(t, "receipts", first, last).select(*keys, "first_log_index")
    sent = F.broadcast if few else lambda df: df
    headed = sent(mine).join(part(t, "headers", first, last).select("block_number", "block_hash", "timestamp"), "block_number")
    joined = sent(sent(headed).join(txs, keys)).join(firsts, keys)
    out = joined.withColumn("block_log_index", F.col("first_log_index") + F.col("log_index")).drop("first_log_index", "block_bucket")
    if limit is not None or ordered:
        out = out.orderBy("block_number", "tx_index", "log_index")
    return out if limit is None else out.limit(limit + 1)


def checked(found: DataFrame, limit: int) -> DataFrame:
    """found, unless it has more than limit rows: all or nothing.

    found has limit + 1 rows at most and is kept (persisted) once counted, so the query runs once;
    unpersist it when it has been read.
    """
    held = found.persist()
    if held.count() > limit:
        held.unpersist()
        raise TooManyLogs(limit)
    return held


def get_logs(t: Tables, f: LogFilter, limit: int) -> DataFrame:
    """Matching logs in order, all or none: more than limit raise TooManyLogs.

    Over tables that stay as they are, logs are counted first, without what is joined to them: a log has one
    header, transaction and receipt at most, so joins make no more of them. Only if that is too many are joined
    rows counted. The rows themselves are read once, by whoever reads the result, and sorted by all tasks. A
    tier whose view isn't pinned may change between two reads; there the rows counted are kept (see `checked`).
    """
    if getattr(t, "version", 0) is None:
        return checked(logs(t, f, limit), limit)
    f = placed(t, f)
    n = matching(t, f).count()
    if n > limit and logs(t, f, few=n <= FEW).count() > limit:
        raise TooManyLogs(limit)
    return logs(t, f, ordered=True, few=n <= FEW)
