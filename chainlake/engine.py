"""The two tiers as one engine: appends, rollbacks, replays and views at a height."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import Backpressure, ColdError, MissingField, NotEmpty, TaskTerminated
from .functions import u256
from .operators import asof, history, ingest, reads, reorg
from .operators.filters import LogFilter
from .schema import TABLES
from .sources import genesis
from .sources.cache import LookupCache
from .sources.config import EngineConfig
from .sources.store import Snapshot, Store, Writer
from .sources.tier import HistoryTier, TierView
from .streaming.logs import MAX_DEADLINE, SPAN, stream_logs

#: Log streams that may run at a time; further ones wait.
MAX_STREAMS = 8
ACCOUNT, SLOT = ["address"], ["address", "slot"]
ACCOUNT_VALUES, SLOT_VALUES = ["nonce", "balance", "bytecode_hash"], ["value"]
#: By state table its changes and its history index.
CHANGES = {"account_state": ("account_changes", "account_history"), "slot_state": ("slot_changes", "slot_history")}
_DEFAULTS: Callable[[], dict[str, Column]] = lambda: {"nonce": F.lit(0).cast("long"), "balance": u256.lit(0), "bytecode_hash": F.lit(None).cast("binary"), "value": u256.lit(0)}


def empty_account() -> Column:
    return (F.col("nonce") == 0) & (F.col("balance") == u256.lit(0)) & F.col("bytecode_hash").isNull()


def empty_slot() -> Column:
    return F.col("value") == u256.lit(0)


class StateFeed:
    """What a run of blocks changed: accounts, slots, wiped accounts and new codes.

    accounts: block_number, address, nonce, balance, bytecode_hash, deleted; slots: block_number,
    address, slot, value; wiped: block_number, address; codes: code_hash, code. Each may be missing.
    """

    SCHEMAS = {
        "accounts": "block_number BIGINT, address BINARY, nonce BIGINT, balance BINARY, bytecode_hash BINARY, deleted BOOLEAN",
        "slots": "block_number BIGINT, address BINARY, slot BINARY, value BINARY",
        "wiped": "block_number BIGINT, address BINARY",
        "codes": "code_hash BINARY, code BINARY",
    }

    def __init__(self, spark: SparkSession, **parts: DataFrame) -> None:
        unknown = set(parts) - set(self.SCHEMAS)
        if unknown:
            raise MissingField(f"unknown parts {sorted(unknown)}")
        for name, ddl in self.SCHEMAS.items():
            setattr(self, name, parts.get(name) if parts.get(name) is not None else spark.createDataFrame([], ddl))


def append_state(w: Writer, headers: DataFrame, feed: StateFeed) -> tuple[int, int]:
    """Stages blocks that extend the tip: headers, pre-images, state, history. Only buckets of touched keys are rewritten.

    Each part of the feed is read once. The rows of touched buckets and the events are put in order by key once;
    pre-images, the buckets' new rows and the blocks to index are then picked from that without another join.
    """
    first, last = ingest.validate_extension(w.tail("headers"), headers)
    accounts = w.stage(ingest.account_events(feed.accounts))
    writes, wiped = w.stage(feed.slots), w.stage(feed.wiped)
    slots = w.stage(ingest.slot_events(w.of_keys("slot_state", wiped.select("address")), writes, wiped))
    w.append("headers", headers)
    for events, state, keys, values in ((accounts, "account_state", ACCOUNT, ACCOUNT_VALUES), (slots, "slot_state", SLOT, SLOT_VALUES)):
        changed, index = CHANGES[state]
        buckets = w.touched(state, events)
        ordered = w.stage(ingest.in_order(events, w.of_buckets(state, buckets), keys, values, last - first + 1))
        new = ingest.changes(ordered, keys, values, _DEFAULTS())
        w.append(changed, new)
        w.replace_buckets(state, buckets, ingest.state_after(ordered, keys, values))
        w.replace_buckets(index, buckets, history.append(w.of_buckets(index, buckets), new, keys, first, last))
    w.upsert("bytecodes", feed.codes.dropDuplicates(["code_hash"]))
    return first, last


def unwind_state(w: Writer, above: int) -> None:
    """Stages the state as of block above: restored values, trimmed history, no later changes or headers. Codes stay."""
    for state, keys, values, is_empty in (("account_state", ACCOUNT, ACCOUNT_VALUES, empty_account()), ("slot_state", SLOT, SLOT_VALUES, empty_slot())):
        changed, index = CHANGES[state]
        back = w.stage(reorg.undone(w.read(changed, above + 1), keys, values, above))
        w.rewrite(state, back.select(*keys), lambda _, b=back, e=is_empty: b.where(~F.coalesce(e, F.lit(True))))
        w.rewrite(index, back.select(*keys), lambda old, k=keys: history.trim(old, k, above))
    for table in ("headers", "account_changes", "slot_changes"):
        w.truncate(table, above)


class StateView:
    """The state at a height (None: now), over one pinned version. Unknown things read as empty."""

    def __init__(self, snapshot: Snapshot, height: int | None = None, check: bool = True) -> None:
        if check:
            reads.check_height(snapshot["headers"], height)
        self.snapshot, self.height = snapshot, height

    @property
    def accounts(self) -> DataFrame:
        return asof.state_at(self.snapshot["account_state"], self.snapshot["account_changes"], ACCOUNT, ACCOUNT_VALUES, self.height)

    @property
    def slots(self) -> DataFrame:
        return asof.state_at(self.snapshot["slot_state"], self.snapshot["slot_changes"], SLOT, SLOT_VALUES, self.height)

    def with_code(self) -> DataFrame:
        """Accounts with their code, empty where they have none."""
        return asof.evm_view(self.accounts, self.snapshot["bytecodes"])

    def values(self, wanted: DataFrame) -> DataFrame:
        """wanted (address, slot) with value, zero where there is none."""
        found = wanted.join(self.slots, SLOT, "left")
        return found.withColumn("value", F.coalesce("value", u256.lit(0)))

    def block_hashes(self, wanted: DataFrame) -> DataFrame:
        """wanted (block_number) with block_hash, zero for unknown blocks."""
        found = wanted.join(self.snapshot["headers"].select("block_number", "block_hash"), "block_number", "left")
        return found.withColumn("block_hash", F.coalesce("block_hash", u256.lit(0)))


class Dispatcher:
    """One background worker with a bounded queue: a full queue or a stopped worker is an error at once.

    cancel, an event that others may set too, stops it before its next job; jobs still queued are dropped.
    """

    def __init__(self, size: int = 256, cancel: threading.Event | None = None) -> None:
        self.jobs: queue.Queue = queue.Queue(size)
        self.failures: list[Exception] = []
        self.cancel = cancel or threading.Event()
        self.stopped = False
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while True:
            try:
                job = self.jobs.get(timeout=0.2)
            except queue.Empty:
                if self.cancel.is_set():
                    return
                continue
            try:
                if job is None:
                    return
                if not self.cancel.is_set():
                    job()
            except Exception as e:
                self.failures.append(e)
            finally:
                self.jobs.task_done()

    def send(self, job: Callable[[], None]) -> None:
        if self.stopped or self.cancel.is_set():
            raise TaskTerminated("the dispatcher has stopped")
        try:
            self.jobs.put_nowait(job)
        except queue.Full:
            raise Backpressure("the dispatch queue is full") from None

    def wait(self) -> None:
        self.jobs.join()

    def stop(self) -> None:
        """Ends the worker behind the jobs it has."""
        if not self.stopped:
            self.stopped = True
            if not self.cancel.is_set():
                self.jobs.put(None)
            self.thread.join()


class Engine:
    """State store and history tier. The state store is authoritative; history follows it and may lag.

    With verify_hashes, blocks whose stored hash isn't that of their header's fields are refused by the
    history tier.
    """

    def __init__(self, spark: SparkSession, hot: Store, cold: HistoryTier, cancel: threading.Event | None = None, verify_hashes: bool = False) -> None:
        self.spark, self.hot, self.cold = spark, hot, cold
        self.verify_hashes = verify_hashes
        self.dispatcher = Dispatcher(cancel=cancel)
        self.cache = LookupCache()
        self.streams = threading.BoundedSemaphore(MAX_STREAMS)

    @classmethod
    def open(cls, spark: SparkSession, config: EngineConfig, cancel: threading.Event | None = None) -> Engine:
        return cls(spark, config.connect_hot(spark), config.connect_cold(spark), cancel)

    def into_hot(self) -> Store:
        """Ends the engine and hands over its state store."""
        self.close()
        return self.hot

    # -- writing --------------------------------------------------------------------------

    def load_genesis(self, document: DataFrame, header: DataFrame | None = None, forks: tuple[str, ...] = ()) -> None:
        """Into an empty store only. Accounts get history entries at the header's block, but no change rows.

        Without a header it is made from the document, with the fields that the forks have.
        """
        with self.hot.writer() as w:
            if w.manifest["headers"]:
                raise NotEmpty("the store has blocks")
            header = w.stage(genesis.header(document, forks) if header is None else header)
            n = header.first()["block_number"]
            made = {name: w.stage(df) for name, df in genesis.tables(document).items()}
            w.append("headers", header)
            for name, df in made.items():
                w.upsert(name, df)
            for table, name, keys in (("account_history", "account_state", ACCOUNT), ("slot_history", "slot_state", SLOT)):
                rows = made[name].select(*keys, F.lit(n).cast("long").alias("block_number"))
                w.replace(table, history.shards(rows, keys))
            w.commit()

    def append_blocks(self, blocks: DataFrame, feed: StateFeed, wait: bool = False) -> None:
        """State first, in one commit; then the history tier is dispatched. Nothing to append is no error."""
        if blocks.isEmpty():
            return
        with self.hot.writer() as w:
            append_state(w, ingest.explode_blocks(blocks)["headers"], feed)
            w.commit()
        self.dispatcher.send(lambda: self.write_history(blocks))
        if wait:
            self.dispatcher.wait()

    def commit_state(self, accounts: DataFrame, slots: DataFrame) -> None:
        """Puts accounts and slots over the current state: no history, no deletions, no codes."""
        with self.hot.writer() as w:
            w.upsert("account_state", accounts)
            w.upsert("slot_state", slots)
            w.commit()

    def write_history(self, blocks: DataFrame) -> None:
        """All history tables of the blocks, in one commit."""
        made = ingest.explode_blocks(blocks)
        if self.verify_hashes:
            made["headers"] = ingest.with_true_hash(made["headers"])
        with self.cold.writer() as w:
            for name, df in made.items():
                w.append(name, df)
            w.commit()

    replay_to_cold = write_history

    def unwind_above(self, block: int) -> None:
        with self.hot.writer() as w:
            unwind_state(w, block)
            w.commit()
        self.dispatcher.send(lambda: self.truncate_history(block))

    def truncate_history(self, block: int) -> None:
        self.cache.drop_above(block)
        try:
            with self.cold.writer() as w:
                for name in self.cold.tables:
                    w.truncate(name, block)
                w.commit()
        finally:
            self.cache.drop_above(block)

    def drain_above(self, block: int) -> DataFrame:
        """Headers above block with their receipts, while both tiers are rolled back to it.

        Paired by block number; blocks that the history tier lacks have no receipts. If that tier
        can't be drained the state is rolled back all the same.
        """
        before = self.hot.snapshot()
        cold = self.cold.snapshot()
        headers = before.read("headers", block + 1)
        with self.hot.writer() as w:
            unwind_state(w, block)
            w.commit()
        drained = reorg.drain(cold, block)
        if cold.version is None:  # a tier without versions forgets what it drops
            drained = self.hot.keep(drained)
        try:
            self.truncate_history(block)
        except ColdError as e:
            self.dispatcher.failures.append(e)
        kind = drained.schema["receipts"].dataType.simpleString()
        out = headers.select(F.struct(*TABLES["headers"].schema.names).alias("header"), "block_number").join(drained, "block_number", "left")
        return out.withColumn("receipts", F.coalesce("receipts", F.array().cast(kind))).orderBy("block_number")

    # -- reading --------------------------------------------------------------------------

    def reader(self, version: int | None = None) -> Snapshot:
        return self.hot.snapshot(version)

    def cold_reader(self, version: int | None = None) -> TierView:
        return self.cold.snapshot(version)

    def header(self, number: int) -> Row | None:
        """A header of the history tier; rows looked up are remembered until a rollback undoes them."""
        return self.cache.get("header", (number,), lambda: self.cold_reader().read("headers", number, number).first())

    def transaction(self, number: int, index: int) -> Row | None:
        """A transaction by place, with its block's hash."""
        return self.cache.get("transaction", (number, index), lambda: reads.transactions(self.cold_reader(), block_number=number, tx_index=index).first())

    def receipt(self, number: int, index: int) -> Row | None:
        """A receipt by place, with block hash and time and its logs."""
        return self.cache.get("receipt", (number, index), lambda: reads.receipts(self.cold_reader(), block_number=number, tx_index=index).first())

    def cold_lag(self) -> int | None:
        return reorg.lag(self.reader()["headers"], self.cold_reader()["headers"]).first()[0]

    def find_gaps(self) -> DataFrame:
        return reorg.gaps(self.reader()["headers"], self.cold_reader()["headers"])

    def accounts_at(self, height: int | None, check: bool = True) -> DataFrame:
        """All accounts at a height; check raises for heights outside the stored blocks."""
        return self.view(height, check).accounts

    def slots_at(self, height: int | None, check: bool = True) -> DataFrame:
        return self.view(height, check).slots

    def view(self, height: int | None = None, check: bool = True) -> StateView:
        return StateView(self.reader(), height, check)

    def get_logs(self, f: LogFilter, limit: int, cold: Mapping[str, DataFrame] | None = None) -> DataFrame:
        return reads.get_logs(self.cold_reader() if cold is None else cold, f, limit)

    def stream_logs(self, f: LogFilter, limit: int, deadline: float = MAX_DEADLINE, span: int = SPAN) -> Iterator[Row]:
        """streaming.stream_logs over the history tier, MAX_STREAMS at a time; the wait counts towards the deadline."""
        if not self.streams.acquire(timeout=max(0.0, min(deadline, MAX_DEADLINE))):
            raise Backpressure(f"{MAX_STREAMS} log streams are running")
        try:
            yield from stream_logs(self.cold, f, limit, deadline, span)
        finally:
            self.streams.release()

    def close(self) -> None:
        self.dispatcher.stop()
