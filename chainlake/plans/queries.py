"""Every registered query of the chain operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import HeightOutOfRange, TooManyLogs
from ..functions import intlist
from ..operators import asof, cursor, history, reads, reorg
from ..operators.filters import LogFilter, block_range
from .chainview import View, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, text: str, **more: str):
    def add(f: Callable[[View], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(View(spark, sf_dir))
        ORACLE[name] = sql(text, **more)
        return f

    return add


# -- logs -------------------------------------------------------------------------------------

_LOG_SQL = """SELECT l.block_number, l.tx_index, l.log_index, address, topic0, topic1, topic2, topic3, data, block_hash, timestamp, t.tx_hash, first_log_index + log_index AS block_log_index
FROM logs l JOIN headers h USING (block_number) JOIN tx t USING (block_number, tx_index) JOIN receipts r USING (block_number, tx_index) WHERE """


def _log_query(name: str, f: LogFilter, where: str, exact: bool = False) -> None:
    """exact: through get_logs, with a limit of just as many logs as match."""

    @query(name, _LOG_SQL + where)
    def run(t: View) -> DataFrame:
        return reads.get_logs(t, f, reads.logs(t, f).count()) if exact else reads.logs(t, f)


_log_query("logs_range", LogFilter(100, 400), "block_number BETWEEN 100 AND 400")
_log_query("logs_by_address", LogFilter(0, 800, address=(7,)), "block_number BETWEEN 0 AND 800 AND address = 7")
_log_query("logs_by_addresses", LogFilter(0, 800, address=(7, 9, 11)), "block_number BETWEEN 0 AND 800 AND address IN (7, 9, 11)")
_log_query("logs_by_topic0", LogFilter(50, 300, topics=(("R",),)), "block_number BETWEEN 50 AND 300 AND topic0 = 'R'")
_log_query("logs_topic0_or", LogFilter(50, 200, topics=(("R", "N"),)), "block_number BETWEEN 50 AND 200 AND topic0 IN ('R', 'N')")
_log_query("logs_topic0_and_topic1", LogFilter(50, 500, topics=(("R",), ("F",))), "block_number BETWEEN 50 AND 500 AND topic0 = 'R' AND topic1 = 'F'")
_log_query("logs_wildcard_topic0", LogFilter(50, 200, topics=((), ("O",))), "block_number BETWEEN 50 AND 200 AND topic1 = 'O'")
_log_query("logs_addr_and_topic", LogFilter(0, 2000, address=(7, 8), topics=(("A",),)), "block_number BETWEEN 0 AND 2000 AND address IN (7, 8) AND topic0 = 'A'")
_log_query("logs_missing_topic", LogFilter(0, 300, topics=((), (), (), (1, 2))), "block_number BETWEEN 0 AND 300 AND topic3 IN (1, 2)")
_log_query("logs_at_block_hash", LogFilter(at_hash=120 * 7919 + 13), "block_hash = 120 * 7919 + 13")
_log_query("logs_unbounded", LogFilter(from_block=2300), "block_number >= 2300")
_log_query("logs_none_match", LogFilter(900_000, 900_999), "block_number BETWEEN 900000 AND 900999")
_log_query("logs_limit_exact", LogFilter(300, 310), "block_number BETWEEN 300 AND 310", exact=True)


@query("logs_limit_overflow", "SELECT count(*) AS matching, count(*) > 50 AS refused FROM logs WHERE block_number BETWEEN 300 AND 400")
def _(t: View) -> DataFrame:
    """As many logs as match pass; one less is refused as a whole."""
    matching = reads.logs(t, LogFilter(300, 400)).count()
    reads.get_logs(t, LogFilter(300, 400), matching).unpersist()
    try:
        reads.get_logs(t, LogFilter(300, 400), min(50, matching)).unpersist()
        refused = False
    except TooManyLogs:
        refused = True
    return t.spark.createDataFrame([(matching, refused)], "matching long, refused boolean")


@query("logs_block_log_index", "SELECT block_number, tx_index, log_index, first_log_index + log_index AS block_log_index FROM logs JOIN receipts USING (block_number, tx_index)")
def _(t: View) -> DataFrame:
    return reads.logs(t, LogFilter()).select("block_number", "tx_index", "log_index", "block_log_index")


# -- headers ----------------------------------------------------------------------------------

_HEADER = "SELECT block_number, block_hash, parent_hash, timestamp FROM headers "


@query("header_by_number", _HEADER + "WHERE block_number = 30")
def _(t: View) -> DataFrame:
    return reads.by_key(t["headers"], block_number=30)


@query("header_by_hash", _HEADER + "WHERE block_hash = 30 * 7919 + 13")
def _(t: View) -> DataFrame:
    return reads.by_key(t["headers"], block_hash=30 * 7919 + 13)


@query("header_number_by_hash", "SELECT block_number FROM headers WHERE block_hash = 41 * 7919 + 13")
def _(t: View) -> DataFrame:
    return reads.by_key(t["headers"], block_hash=41 * 7919 + 13).select("block_number")


@query(
    "headers_by_specs",
    "SELECT CAST(pos AS INTEGER) AS pos, h.block_number, block_hash, parent_hash, timestamp FROM (VALUES (0, 500), (1, 999999), (2, 3), (3, 500)) s(pos, n) LEFT JOIN headers h ON n = h.block_number",
)
def _(t: View) -> DataFrame:
    specs = t.spark.createDataFrame([(0, 500), (1, 999_999), (2, 3), (3, 500)], "pos int, block_number long")
    return reads.by_specs(t["headers"], specs, ["block_number"])


@query("headers_range", _HEADER + "WHERE block_number BETWEEN 10 AND 60")
def _(t: View) -> DataFrame:
    return reads.in_range(t["headers"], 10, 60)


@query("latest_block", "SELECT max(block_number) AS latest_block FROM headers")
def _(t: View) -> DataFrame:
    return reads.latest_block(t["headers"])


@query("chain_tip", "SELECT block_number, block_hash FROM headers ORDER BY block_number DESC LIMIT 1")
def _(t: View) -> DataFrame:
    return reads.tip(t["headers"])


@query("first_header", _HEADER + "ORDER BY block_number LIMIT 1")
def _(t: View) -> DataFrame:
    return reads.first_header(t["headers"])


@query("last_header", _HEADER + "ORDER BY block_number DESC LIMIT 1")
def _(t: View) -> DataFrame:
    return reads.last_header(t["headers"])


@query("execution_range", "SELECT min(block_number) AS first_block, max(block_number) AS last_block FROM headers")
def _(t: View) -> DataFrame:
    return reads.execution_range(t["headers"])


@query("has_block", "SELECT count(*) > 0 AS present FROM headers WHERE block_number = 77")
def _(t: View) -> DataFrame:
    return reads.has_block(t["headers"], 77)


# -- transactions and receipts ----------------------------------------------------------------

_TX = "SELECT block_number, tx_index, tx_hash, from_address, to_address, value, block_hash FROM tx JOIN headers USING (block_number) "


@query("tx_by_hash", _TX + "WHERE tx_hash = 1234")
def _(t: View) -> DataFrame:
    return reads.transactions(t, tx_hash=1234)


@query("tx_by_block_index", _TX + "WHERE block_number = 120 AND tx_index = 1")
def _(t: View) -> DataFrame:
    return reads.transactions(t, block_number=120, tx_index=1)


@query("tx_by_block_hash_index", _TX + "WHERE block_hash = 120 * 7919 + 13 AND tx_index = 0")
def _(t: View) -> DataFrame:
    return reads.transactions(t, block_hash=120 * 7919 + 13, tx_index=0)


@query("txs_in_block", "SELECT block_number, tx_index, tx_hash, from_address, to_address, value FROM tx WHERE block_number = 120")
def _(t: View) -> DataFrame:
    return reads.transactions_in_block(t, 120)


@query("tx_count", "SELECT count(*) AS tx_count FROM tx WHERE block_number = 120")
def _(t: View) -> DataFrame:
    return reads.transaction_count(t, 120)


@query("tx_count_unknown_block", "SELECT count(*) AS tx_count FROM tx WHERE block_number = 999999")
def _(t: View) -> DataFrame:
    return reads.transaction_count(t, 999_999)


_RECEIPT = """SELECT r.block_number, r.tx_index, r.tx_hash, r.from_address, cumulative_gas_used, gas_used, first_log_index, block_hash, timestamp,
       coalesce(string_agg(CAST(first_log_index + log_index AS VARCHAR) || ':' || CAST(l.address AS VARCHAR) || ':' || CAST(data AS VARCHAR), ',' ORDER BY log_index), '') AS logs
FROM receipts r JOIN headers h USING (block_number) LEFT JOIN logs l USING (block_number, tx_index) WHERE {} GROUP BY ALL"""


def _flat(receipts: DataFrame) -> DataFrame:
    one = F.transform("logs", lambda x: F.concat_ws(":", x["log_index"].cast("string"), x["address"].cast("string"), x["data"].cast("string")))
    return receipts.withColumn("logs", F.array_join(one, ","))


@query("receipt_by_hash", _RECEIPT.format("r.tx_hash = 1234"))
def _(t: View) -> DataFrame:
    return _flat(reads.receipts(t, tx_hash=1234))


@query("receipt_by_block_index", _RECEIPT.format("r.block_number = 120 AND r.tx_index = 1"))
def _(t: View) -> DataFrame:
    return _flat(reads.receipts(t, block_number=120, tx_index=1))


@query("receipts_in_block", _RECEIPT.format("r.block_number = 121"))
def _(t: View) -> DataFrame:
    return _flat(reads.receipts_in_block(t, 121))


@query("receipt_gas_used", "SELECT block_number, tx_index, cumulative_gas_used, gas_used FROM receipts")
def _(t: View) -> DataFrame:
    return reads.derive_receipts(t.gas).select("block_number", "tx_index", "cumulative_gas_used", "gas_used")


@query("receipt_first_log_index", "SELECT block_number, tx_index, first_log_index FROM receipts")
def _(t: View) -> DataFrame:
    return reads.derive_receipts(t.gas.drop("n_logs"), t["logs"]).select("block_number", "tx_index", "first_log_index")


# -- bridge events and rollup headers ---------------------------------------------------------

_EVENT = "SELECT block_number, event_index, event_type, sender, value FROM bridge_events "


@query("events_in_block", _EVENT + "WHERE block_number = 5")
def _(t: View) -> DataFrame:
    return reads.events_in_range(t, 5, 5)


@query("events_in_range", _EVENT + "WHERE block_number BETWEEN 3 AND 9")
def _(t: View) -> DataFrame:
    return reads.events_in_range(t, 3, 9)


@query("rollup_header_by_number", "SELECT block_number, rollup_chain_id, reward_address FROM rollup_headers WHERE block_number = 4")
def _(t: View) -> DataFrame:
    return reads.rollup_header(t, 4)


@query("rollup_headers_range", "SELECT block_number, rollup_chain_id, reward_address FROM rollup_headers WHERE block_number BETWEEN 4 AND 11")
def _(t: View) -> DataFrame:
    return reads.rollup_headers(t, 4, 11)


# -- state and its history --------------------------------------------------------------------


@query("account_get", "SELECT address, nonce, balance FROM account_state WHERE address = 8")
def _(t: View) -> DataFrame:
    return reads.by_key(t["account_state"], address=8)


@query("slot_get", "SELECT address, slot, value FROM slot_state WHERE address = 8 AND slot = 'click'")
def _(t: View) -> DataFrame:
    return reads.by_key(t["slot_state"], address=8, slot="click")


@query("account_change_get", "SELECT block_number, address, pre_nonce, pre_balance FROM account_changes WHERE block_number = 7 AND address = 8")
def _(t: View) -> DataFrame:
    return reads.by_key(t["account_changes"], block_number=7, address=8)


@query("slot_change_get", "SELECT block_number, address, slot, pre_value FROM slot_changes WHERE block_number = 7 AND address = 8")
def _(t: View) -> DataFrame:
    return reads.by_key(t["slot_changes"], block_number=7, address=8)


_SLOTS_AT = """SELECT address, slot, CASE WHEN p.b IS NOT NULL THEN p.pre ELSE s.value END AS value
FROM slot_state s LEFT JOIN (SELECT address, slot, arg_min({{'v': pre_value}}, block_number).v AS pre, min(block_number) AS b FROM slot_changes WHERE block_number > {0} GROUP BY ALL) p USING (address, slot)"""


@query("slots_at_height", _SLOTS_AT.format(12))
def _(t: View) -> DataFrame:
    reads.check_height(t["slot_changes"], 12)
    return asof.state_at(t["slot_state"], t["slot_changes"], ["address", "slot"], ["value"], 12)


@query("slots_at_first_height", _SLOTS_AT.format(0))
def _(t: View) -> DataFrame:
    return asof.state_at(t["slot_state"], t["slot_changes"], ["address", "slot"], ["value"], 0)


@query(
    "account_at_height",
    """SELECT address, CASE WHEN p.b IS NOT NULL THEN p.pre.n ELSE s.nonce END AS nonce, CASE WHEN p.b IS NOT NULL THEN p.pre.b ELSE s.balance END AS balance
FROM account_state s LEFT JOIN (SELECT address, arg_min({'n': pre_nonce, 'b': pre_balance}, block_number) AS pre, min(block_number) AS b FROM account_changes WHERE block_number > 12 GROUP BY ALL) p USING (address)""",
)
def _(t: View) -> DataFrame:
    return asof.state_at(t["account_state"], t["account_changes"], ["address"], ["nonce", "balance"], 12)


@query("account_current", "SELECT address, nonce, balance FROM account_state")
def _(t: View) -> DataFrame:
    return asof.state_at(t["account_state"], t["account_changes"], ["address"], ["nonce", "balance"], None)


@query(
    "batch_as_of",
    """SELECT q.address, q.slot, q.height, (SELECT w.value FROM written w WHERE w.address = q.address AND w.slot = q.slot AND w.block_number <= q.height ORDER BY w.block_number DESC LIMIT 1) AS value
FROM (SELECT address, slot, unnest([0, 3, 9, 15, 22, 29]) AS height FROM slot_state) q""",
)
def _(t: View) -> DataFrame:
    heights = F.explode(F.array(*(F.lit(h).cast("long") for h in (0, 3, 9, 15, 22, 29))))
    requests = t["slot_state"].select("address", "slot", heights.alias("height"))
    return asof.batch_state_at(requests, t["slot_state"], t["slot_changes"], ["address", "slot"], ["value"]).withColumn("height", F.col("height").cast("int"))


@query(
    "forward_replay",
    "SELECT address, slot, arg_max(value, block_number) AS value FROM written WHERE block_number <= 12 GROUP BY ALL",
)
def _(t: View) -> DataFrame:
    at = asof.intervals(t["slot_state"], t["slot_changes"], ["address", "slot"], ["value"])
    open_from = F.coalesce("valid_from", F.lit(-1)) <= 12
    return at.where(open_from & (F.coalesce("valid_to", F.lit(1 << 62)) > 12) & F.col("value").isNotNull()).select("address", "slot", "value")


@query("height_check", "SELECT h AS height, h BETWEEN (SELECT min(block_number) FROM headers) AND (SELECT max(block_number) FROM headers) AS ok FROM (VALUES (-1), (0), (1200), (99999)) v(h)")
def _(t: View) -> DataFrame:
    def ok(height: int) -> bool:
        try:
            reads.check_height(t["headers"], height)
        except HeightOutOfRange:
            return False
        return True

    return t.spark.createDataFrame([(h, ok(h)) for h in (-1, 0, 1200, 99_999)], "height int, ok boolean")


@query("evm_view", "SELECT address, nonce, balance, CASE WHEN address % 3 = 0 THEN 'code' || CAST(address % 5 AS VARCHAR) ELSE '' END AS code FROM account_state")
def _(t: View) -> DataFrame:
    codes = t.spark.createDataFrame([(i, f"code{i}".encode()) for i in range(5)], "code_hash long, code binary")
    accounts = t["account_state"].withColumn("bytecode_hash", F.when(F.col("address") % 3 == 0, F.col("address") % 5))
    return asof.evm_view(accounts, codes).select("address", "nonce", "balance", F.col("code").cast("string").alias("code"))


@query("changed_accounts_range", "SELECT address, string_agg(CAST(block_number AS VARCHAR), ',' ORDER BY block_number) AS blocks FROM account_changes WHERE block_number BETWEEN 4 AND 11 GROUP BY address")
def _(t: View) -> DataFrame:
    return _listed(history.changed(t["account_changes"], ["address"], 4, 11))


@query("changed_slots_range", "SELECT address, slot, string_agg(CAST(block_number AS VARCHAR), ',' ORDER BY block_number) AS blocks FROM slot_changes WHERE block_number BETWEEN 4 AND 11 GROUP BY address, slot")
def _(t: View) -> DataFrame:
    return _listed(history.changed(t["slot_changes"], ["address", "slot"], 4, 11))


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("blocks", F.array_join(F.transform("blocks", lambda x: x.cast("string")), ","))


_SHARDS = """SELECT address, CASE WHEN open THEN 9223372036854775807 ELSE hi END AS highest, open AS is_open, blocks
FROM (SELECT address, s, max(block_number) AS hi, string_agg(CAST(block_number AS VARCHAR), ',' ORDER BY block_number) AS blocks, s = max(s) OVER (PARTITION BY address) AS open
      FROM (SELECT address, block_number, (row_number() OVER (PARTITION BY address ORDER BY block_number) - 1) // {cap} AS s FROM account_changes WHERE {where}) GROUP BY address, s)"""


@query("history_shards", _SHARDS.format(cap=7, where="TRUE"))
def _(t: View) -> DataFrame:
    return _listed(history.shards(t["account_changes"], ["address"], cap=7))


@query("history_append", _SHARDS.format(cap=7, where="block_number <= 25"))
def _(t: View) -> DataFrame:
    old = history.shards(block_range(t["account_changes"], None, 14), ["address"], cap=7)
    return _listed(history.append(old, t["account_changes"], ["address"], 15, 25, cap=7))


@query("history_trim", _SHARDS.format(cap=7, where="block_number <= 11"))
def _(t: View) -> DataFrame:
    return _listed(history.trim(history.shards(t["account_changes"], ["address"], cap=7), ["address"], 11))


@query("history_last_shard", "SELECT * FROM (" + _SHARDS.format(cap=7, where="TRUE") + ") WHERE is_open")
def _(t: View) -> DataFrame:
    return _listed(history.last_shard(history.shards(t["account_changes"], ["address"], cap=7), ["address"]))


@query(
    "history_rank_select",
    """SELECT address, CAST(count(*) FILTER (block_number <= 12) AS BIGINT) AS rank, (list(block_number ORDER BY block_number))[count(*) FILTER (block_number <= 12) + 1] AS selected,
       min(block_number) AS smallest, max(block_number) AS largest, count(*) AS length, bool_or(block_number = 9) AS has_nine FROM account_changes GROUP BY address""",
)
def _(t: View) -> DataFrame:
    lists = history.changed(t["account_changes"], ["address"])
    rank = intlist.rank("blocks", 12)
    return lists.select(
        "address", rank.alias("rank"), intlist.select("blocks", rank).alias("selected"), intlist.smallest("blocks").alias("smallest"), intlist.largest("blocks").alias("largest"), intlist.length("blocks").alias("length"), intlist.contains("blocks", 9).alias("has_nine")
    )


# -- cursors ----------------------------------------------------------------------------------

_S = "SELECT address, slot, value FROM slot_state "
_KEYS = ("address", "slot")


def _slots(name: str, text: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, text)(lambda t: f(t["slot_state"]))


_slots("cursor_scan", _S, lambda s: cursor.scan(s, *_KEYS))
_slots("cursor_scan_from", _S + "WHERE (address, slot) >= (40, 'error')", lambda s: cursor.scan_from(s, _KEYS, (40, "error")))
_slots("cursor_first", _S + "ORDER BY address, slot LIMIT 1", lambda s: cursor.first(s, *_KEYS))
_slots("cursor_last", _S + "ORDER BY address DESC, slot DESC LIMIT 1", lambda s: cursor.last(s, *_KEYS))
_slots("cursor_next_above_dual", _S + "WHERE (address, slot) >= (40, 'zzz') ORDER BY address, slot LIMIT 1", lambda s: cursor.lower_bound(s, _KEYS, (40, "zzz")))
_slots("cursor_next_k1", _S + "WHERE address > 40 ORDER BY address, slot LIMIT 1", lambda s: cursor.next_k1(s, *_KEYS, 40))
_slots("cursor_prev_k1", _S + "WHERE address < 40 ORDER BY address DESC, slot DESC LIMIT 1", lambda s: cursor.previous_k1(s, *_KEYS, 40))
_slots("cursor_last_of_k1", "SELECT address, max(slot) AS slot, arg_max(value, slot) AS value FROM slot_state GROUP BY address", lambda s: cursor.last_of_k1(s, *_KEYS))
_slots("cursor_lead_lag", "SELECT address, slot, value, lag(slot) OVER w AS previous_key, lead(slot) OVER w AS next_key FROM slot_state WINDOW w AS (PARTITION BY address ORDER BY slot)", lambda s: cursor.neighbours(s, "slot", "address"))
_slots("iter_k2", _S + "WHERE address = 33", lambda s: cursor.within_k1(s, *_KEYS, 33))
_slots("iter_items", "SELECT address, slot, value, row_number() OVER (PARTITION BY address ORDER BY slot) = 1 AS is_new_k1 FROM slot_state", lambda s: cursor.items(s, *_KEYS))
_slots("delete_range_dual", _S + "WHERE NOT ((address, slot) >= (20, 'error') AND (address, slot) <= (60, 'error'))", lambda s: cursor.delete_range(s, _KEYS, (20, "error"), (60, "error")))
_slots("take_range_dual", _S + "WHERE (address > 20 AND address < 60) OR (address = 20 AND slot >= 'error') OR (address = 60 AND slot <= 'error')", lambda s: cursor.take_range(s, _KEYS, (20, "error"), (60, "error"))[0])
_slots("clear_k1", _S + "WHERE address <> 33", lambda s: cursor.clear_k1(s, "address", 33))
_slots("cursor_delete_current", _S + "WHERE NOT (address = 33 AND slot = 'click')", lambda s: cursor.delete_keys(s, reads.by_key(s, address=33, slot="click"), _KEYS))


@query("cursor_lower_bound", _HEADER + "WHERE block_number >= 15 ORDER BY block_number LIMIT 1")
def _(t: View) -> DataFrame:
    return cursor.lower_bound(t["headers"], ["block_number"], [15])


@query("delete_range", _HEADER + "WHERE NOT (block_number BETWEEN 5 AND 90)")
def _(t: View) -> DataFrame:
    return cursor.delete_range(t["headers"], ["block_number"], [5], [90])


@query("delete_range_exclusive", _HEADER + "WHERE NOT (block_number >= 5 AND block_number < 90)")
def _(t: View) -> DataFrame:
    return cursor.delete_range(t["headers"], ["block_number"], [5], [90], inclusive=False)


@query("take_range", _HEADER + "WHERE block_number BETWEEN 3 AND 60")
def _(t: View) -> DataFrame:
    return cursor.take_range(t["headers"], ["block_number"], [3], [60])[0]


@query("get_many", "SELECT k AS address, nonce, balance FROM (VALUES (8), (100000), (33)) v(k) LEFT JOIN account_state ON address = k")
def _(t: View) -> DataFrame:
    wanted = t.spark.createDataFrame([(8,), (100_000,), (33,)], "address long")
    return cursor.get_many(t["account_state"], wanted, ["address"]).withColumn("address", F.col("address").cast("int"))


# -- writes and reorganisations ---------------------------------------------------------------


@query("upsert_merge", "SELECT address, nonce, balance FROM account_state WHERE address % 10 <> 0 UNION ALL SELECT address, nonce + 1, balance * 2 FROM account_state WHERE address % 10 = 0 UNION ALL SELECT 1000000, 1, 5")
def _(t: View) -> DataFrame:
    state = t["account_state"]
    rows = state.where("address % 10 = 0").select("address", (F.col("nonce") + 1).alias("nonce"), (F.col("balance") * 2).alias("balance"))
    return cursor.upsert(state, rows.unionByName(t.spark.createDataFrame([(1_000_000, 1, 5)], "address long, nonce long, balance long")), ["address"])


@query("wipe_preimages", "SELECT CAST(30 AS BIGINT) AS block_number, address, slot, value AS pre_value FROM slot_state WHERE address IN (3, 8)")
def _(t: View) -> DataFrame:
    from ..operators.ingest import wipe_preimages

    return wipe_preimages(t["slot_state"], t.spark.createDataFrame([(30, 3), (30, 8)], "block_number long, address long"))


@query("unwind_state", "SELECT address, slot, arg_max(value, block_number) AS value FROM written WHERE block_number <= 12 GROUP BY ALL HAVING arg_max(value, block_number) <> 0")
def _(t: View) -> DataFrame:
    return reorg.unwind(t["slot_state"], t["slot_changes"], ["address", "slot"], ["value"], 12, F.col("value") == 0)


@query("unwind_accounts", "SELECT address, max(nonce) AS nonce, arg_max(balance, block_number) AS balance FROM moved WHERE block_number <= 3 GROUP BY ALL")
def _(t: View) -> DataFrame:
    return reorg.unwind(t["account_state"], t["account_changes"], ["address"], ["nonce", "balance"], 3, F.col("nonce") == 0)


@query("unwind_changes", "SELECT block_number, address, slot, pre_value FROM slot_changes WHERE block_number <= 12")
def _(t: View) -> DataFrame:
    return reorg.truncate({"c": t["slot_changes"]}, 12)["c"]


@query(
    "truncate_above",
    "SELECT name, n FROM (SELECT 'headers' AS name, count(*) AS n FROM headers WHERE block_number <= 1000 UNION ALL SELECT 'transactions', count(*) FROM tx WHERE block_number <= 1000 UNION ALL SELECT 'receipts', count(*) FROM receipts WHERE block_number <= 1000 UNION ALL SELECT 'logs', count(*) FROM logs WHERE block_number <= 1000)",
)
def _(t: View) -> DataFrame:
    kept = reorg.truncate({n: t[n] for n in ("headers", "transactions", "receipts", "logs")}, 1000)
    counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in kept.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "drain_above",
    "SELECT h.block_number, coalesce(string_agg(CAST(tx_index AS VARCHAR) || ':' || CAST(gas_used AS VARCHAR) || ':' || CAST(n_logs AS VARCHAR), ',' ORDER BY tx_index), '') AS receipts FROM headers h LEFT JOIN receipts r USING (block_number) LEFT JOIN gas g USING (block_number, tx_index) WHERE h.block_number > 2350 GROUP BY h.block_number",
)
def _(t: View) -> DataFrame:
    one = F.transform("receipts", lambda r: F.concat_ws(":", r["tx_index"].cast("string"), r["gas_used"].cast("string"), F.size(r["logs"]).cast("string")))
    return reorg.drain(t, 2350).select("block_number", F.array_join(one, ",").alias("receipts"))


@query("cold_lag", "SELECT max(block_number) + 1 AS first_missing FROM headers WHERE block_number <= 1000")
def _(t: View) -> DataFrame:
    return reorg.lag(t["headers"], block_range(t["headers"], None, 1000))


@query("find_gaps", "SELECT block_number, block_number % 50 <> 1 AS in_hot, block_number % 50 <> 0 AS in_cold FROM headers WHERE block_number % 50 IN (0, 1)")
def _(t: View) -> DataFrame:
    return reorg.gaps(t["headers"].where("block_number % 50 <> 1"), t["headers"].where("block_number % 50 <> 0"))


@query("number_gaps", "SELECT before + 1 AS gap_start, block_number - 1 AS gap_end FROM (SELECT block_number, lag(block_number) OVER (ORDER BY block_number) AS before FROM headers) WHERE block_number > before + 1")
def _(t: View) -> DataFrame:
    return reorg.number_gaps(t["headers"])


@query(
    "chain_extension_check",
    """SELECT block_number, CASE WHEN before IS NULL OR before < block_number - 1 THEN 'gap' ELSE 'parent' END AS kind
FROM (SELECT block_number, parent_hash, lag(block_number) OVER w AS before, lag(block_hash) OVER w AS hash FROM headers WINDOW w AS (ORDER BY block_number))
WHERE before IS NOT NULL AND (before < block_number - 1 OR hash <> parent_hash)""",
)
def _(t: View) -> DataFrame:
    return reorg.breaks(t["headers"])


@query("replay_missing", "SELECT block_number, tx_index, tx_hash FROM tx WHERE block_number % 50 = 0")
def _(t: View) -> DataFrame:
    cold = {"headers": t["headers"].where("block_number % 50 <> 0"), "transactions": t["transactions"]}
    return reorg.level(t["headers"], cold)["transactions"].select("block_number", "tx_index", "tx_hash")


@query("explode_blocks", "SELECT block_number, tx_index, tx_hash, from_address FROM tx")
def _(t: View) -> DataFrame:
    from ..operators.ingest import explode_part

    body = F.struct("tx_hash", "from_address")
    blocks = t["transactions"].groupBy("block_number").agg(F.sort_array(F.collect_list(F.struct("tx_index", body.alias("body")))).alias("l")).select("block_number", F.transform("l", lambda x: x["body"]).alias("transactions"))
    return explode_part(blocks, "transactions", "tx_index")


@query("gas_by_block", "SELECT block_number, max(cumulative_gas_used) AS gas_used, count(*) AS txs FROM receipts GROUP BY block_number")
def _(t: View) -> DataFrame:
    return t.gas.groupBy("block_number").agg(F.max("cumulative_gas_used").alias("gas_used"), F.count(F.lit(1)).alias("txs"))


@query("cursor_header_neighbours", "SELECT block_number, lag(block_number) OVER w AS previous_key, lead(block_number) OVER w AS next_key FROM headers WINDOW w AS (ORDER BY block_number)")
def _(t: View) -> DataFrame:
    return cursor.neighbours(t["headers"].select("block_number"), "block_number")

