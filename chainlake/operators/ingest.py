"""Blocks into tables: exploding bundles, deriving receipts, checking the chain, splitting change feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyRange, MissingField, NonContiguous, ParentMismatch
from ..functions import rlp
from ..schema import BLOCKS_PER_BUCKET
from .asof import with_previous
from .reads import derive_receipts, tip
from .reorg import breaks


class BlockBuilder:
    """Puts one block bundle together; build() raises MissingField unless there are a header and a body."""

    def __init__(self) -> None:
        self.parts: dict[str, object] = {"events": [], "rollup_header": None}

    def header(self, **fields) -> BlockBuilder:
        self.parts["header"] = fields
        return self

    def body(self, transactions: list[dict], receipts: list[dict]) -> BlockBuilder:
        self.parts |= {"transactions": transactions, "receipts": receipts}
        return self

    def events(self, events: list[dict]) -> BlockBuilder:
        self.parts["events"] = events
        return self

    def rollup_header(self, **fields) -> BlockBuilder:
        self.parts["rollup_header"] = fields
        return self

    def build(self) -> dict[str, object]:
        """The bundle as a row for createDataFrame with the caller's bundle schema."""
        for part in ("header", "transactions", "receipts"):
            if part not in self.parts:
                raise MissingField(f"the block has no {part}")
        if len(self.parts["transactions"]) != len(self.parts["receipts"]):
            raise MissingField("transactions and receipts differ in number")
        return dict(self.parts)


def explode_part(blocks: DataFrame, part: str, index: str, number: Column | None = None) -> DataFrame:
    """One row for each element of an array column: block number, place in the array, the element's fields."""
    number = F.col("block_number") if number is None else number
    return blocks.select(number.alias("block_number"), F.posexplode(part).alias(index, "item")).select("block_number", F.col(index).cast("long").alias(index), "item.*")


def explode_blocks(blocks: DataFrame) -> dict[str, DataFrame]:
    """The history tables of block bundles.

    blocks: header STRUCT, transactions ARRAY<STRUCT>, receipts ARRAY<STRUCT<..., logs ARRAY<STRUCT>>>,
    events ARRAY<STRUCT>, rollup_header STRUCT. Unequal numbers of transactions and receipts raise.
    Each table is a narrow map of the bundles but for the receipts' running sums within their block.
    """
    n = F.col("header.block_number")
    same = F.size("transactions") == F.size("receipts")
    checked = blocks.withColumn("receipts", F.when(same, F.col("receipts")).otherwise(F.raise_error(F.lit("transactions and receipts differ in number")).cast(blocks.schema["receipts"].dataType)))
    paired = checked.withColumn("receipts", F.arrays_zip("transactions", "receipts"))
    flat = paired.select(n.alias("block_number"), F.posexplode("receipts").alias("tx_index", "x")).select("block_number", F.col("tx_index").cast("long").alias("tx_index"), "x.receipts.*", "x.transactions.tx_hash", "x.transactions.from_address")
    logs = flat.select("block_number", "tx_index", F.posexplode("logs").alias("log_index", "l")).select("block_number", "tx_index", F.col("log_index").cast("long").alias("log_index"), "l.*")
    receipts = derive_receipts(flat.withColumn("n_logs", F.size("logs").cast("long")).drop("logs")).drop("n_logs")
    return {
        "headers": blocks.select("header.*"),
        "transactions": explode_part(checked, "transactions", "tx_index", n),
        "receipts": receipts,
        "logs": logs,
        "bridge_events": explode_part(checked, "events", "event_index", n),
        "rollup_headers": blocks.where("rollup_header IS NOT NULL").select(n.alias("block_number"), "rollup_header.*"),
    }


def with_true_hash(headers: DataFrame) -> DataFrame:
    """headers, raising when read if a stored hash isn't the hash of the header's own fields."""
    checked = rlp.with_hash(headers, "own_hash")
    right = F.when(F.col("own_hash") == F.col("block_hash"), F.col("block_hash")).otherwise(F.raise_error(F.lit("a block's hash isn't that of its header")).cast("binary"))
    return checked.withColumn("block_hash", right).drop("own_hash")


def validate_extension(headers: DataFrame, new: DataFrame) -> tuple[int, int]:
    """(first, last) of new if it extends the tip of headers link by link; raises otherwise.

    Everything is compared by equi-joins and aggregates; a few rows reach the driver. headers need only
    hold the highest block.
    """
    span = new.agg(F.min("block_number"), F.max("block_number"), F.count(F.lit(1)), F.min_by("parent_hash", "block_number")).first()
    first, last, n, parent = span
    if not n:
        raise EmptyRange("no blocks to append")
    if last - first + 1 != n:
        raise NonContiguous(f"{n} blocks between {first} and {last}")
    at = tip(headers).first()
    if at["block_number"] is not None:
        if first != at["block_number"] + 1:
            raise NonContiguous(f"block {first} after tip {at['block_number']}")
        if parent != at["block_hash"]:
            raise ParentMismatch(f"block {first} doesn't name the tip as its parent")
    wrong = breaks(new).orderBy("block_number").first()
    if wrong:
        raise (NonContiguous if wrong["kind"] == "gap" else ParentMismatch)(f"block {wrong['block_number']}")
    return first, last


def account_events(feed: DataFrame) -> DataFrame:
    """(block_number, address, after) of a feed unique by block and address: what an account is after a block, null if deleted."""
    after = F.struct("nonce", "balance", "bytecode_hash")
    return feed.select("block_number", "address", F.when(~F.coalesce("deleted", F.lit(False)), after).alias("after"))


def slot_events(current: DataFrame, feed: DataFrame, wiped: DataFrame) -> DataFrame:
    """(block_number, address, slot, after) of writes and wipes: what a slot is after a block, null if wiped and not written again.

    A wiped account (block_number, address) is cleared before the block's writes: each of its slots, of
    the state before or written by the feed, gets a row for the wipe. current need only hold these accounts.
    """
    writes = feed.select("block_number", "address", "slot", F.struct("value").alias("after"))
    wipes = wiped.select("address", "block_number").distinct()
    known = current.select("address", "slot").unionByName(feed.select("address", "slot")).distinct()
    cleared = known.join(wipes, "address").select("block_number", "address", "slot", F.lit(None).cast(writes.schema["after"].dataType).alias("after"))
    return cleared.join(writes.select("block_number", "address", "slot"), ["block_number", "address", "slot"], "left_anti").unionByName(writes)


def in_order(events: DataFrame, current: DataFrame, keys: Sequence[str], values: Sequence[str], blocks: int) -> DataFrame:
    """Current rows, at block -1, and events behind them, each with what its key was before (pre), and whether it is its key's last.

    events lie in so many blocks, whatever number. The current state of a key comes before its first event,
    each event before the next, so writes, wipes and deletions of one append are seen in order.
    """
    base = current.select(F.lit(-1).cast("long").alias("block_number"), *keys, F.struct(*values).alias("after"))
    return with_previous(events.select("block_number", *keys, "after").unionByName(base), keys, "pre", "after", last="is_last", together=blocks <= BLOCKS_PER_BUCKET)


def changes(ordered: DataFrame, keys: Sequence[str], values: Sequence[str], defaults: Mapping[str, Column]) -> DataFrame:
    """Change rows of what in_order gives: what each key was before each block.

    A key that wasn't there shows the defaults, with existed false; a wipe of a slot that wasn't there
    changes nothing.
    """
    real = ordered.where("block_number >= 0 AND (after IS NOT NULL OR pre IS NOT NULL)")
    there = F.col("pre").isNotNull()
    return real.select("block_number", *keys, there.alias("existed"), *(F.when(there, F.col(f"pre.{v}")).otherwise(defaults[v]).alias(f"pre_{v}") for v in values))


def state_after(ordered: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The state after all that in_order gives; what is deleted or wiped by then has no row. Zero slots are kept."""
    return ordered.where("is_last AND after IS NOT NULL").select(*keys, *(F.col(f"after.{v}").alias(v) for v in values))


def wipe_preimages(current: DataFrame, wiped: DataFrame) -> DataFrame:
    """Pre-images of every slot of the wiped accounts (block_number, address), from the version before."""
    return current.join(wiped, "address").select("block_number", "address", "slot", F.col("value").alias("pre_value"))
